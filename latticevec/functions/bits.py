"""Pseudo-random ids and Bloom filters: integer arithmetic modulo 2^32, and the closed forms that size a filter."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 1 << 32
#: Multiplier and increment of the linear congruential generator.
LCG_MULTIPLIER, LCG_INCREMENT = 1103515245, 12345
#: Words of the filter, its hash functions, and the multipliers of each of these, two by two.
FILTER_WORDS, FILTER_HASHES = 512, 3
MULTIPLIERS = [0x924ED183, 0xD854FC0A, 0xECF5E3B7, 0x1BEAD407, 0x28A30449, 0xBFC4D99F]
#: Bits for each entry of a beam, and the largest rate of false positives.
BITS_PER_ENTRY, LARGEST_RATE = 12.897, 0.03


def times_mod(x: Column, factor: int) -> Column:
    """x * factor modulo 2^32 for 0 <= x < 2^32, without an overflow of 64 bits: by halves of the factor."""
    high, low = factor >> 16, factor & 0xFFFF
    upper = ((x * F.lit(high)) % F.lit(1 << 16)) * F.lit(1 << 16)
    return (upper + x * F.lit(low)) % F.lit(WORD)


def lcg(seed: Column) -> Column:
    """The generator's next state."""
    return (times_mod(seed.cast("long"), LCG_MULTIPLIER) + F.lit(LCG_INCREMENT)) % F.lit(WORD)


def random_id(seed: Column, low: Column, high: Column) -> Column:
    """An id in [low, high) from a state."""
    return low + seed % (high - low)


def filter_slot(x: Column, h: int) -> Column:
    """The bit that hash function h of the filter gives an id."""
    x = x.cast("long")
    for shift, factor in ((16, MULTIPLIERS[2 * h]), (13, MULTIPLIERS[2 * h + 1])):
        x = times_mod(x.bitwiseXOR(F.shiftrightunsigned(x, shift)), factor)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16)) % F.lit(FILTER_WORDS * 32)


def filter_word(slot: Column) -> Column:
    return slot % F.lit(FILTER_WORDS)


def filter_bit(slot: Column) -> Column:
    return F.floor(slot / F.lit(FILTER_WORDS)).cast("long")


def rate(k: Column, r: Column) -> Column:
    """False positives with k hash functions and r bits an entry."""
    return F.pow(1 - F.exp(-k / r), k)


def best_hashes(r: Column) -> Column:
    return F.round(F.lit(math.log(2)) * r)


def bits_an_entry(p: Column, k: Column) -> Column:
    """Bits an entry for a rate p with k hash functions."""
    return -k / F.log(1 - F.exp(F.log(p) / k))


def bits_for(n: Column, p: Column) -> Column:
    """Bits for n entries at a rate p, with as many hash functions as suit them: -n ln p / (ln 2)^2."""
    return F.ceil(-n * F.log(p) / F.lit(math.log(2) ** 2))


def entries_for(m: Column, k: Column, p: Column) -> Column:
    """Entries that m bits hold at a rate p with k hash functions."""
    return F.ceil(m / bits_an_entry(p, k))


#: Words of the smallest and of the largest filter, as powers of two.
LEAST_EXPONENT, MOST_EXPONENT = 1, 11


def filter_shape(beam: int) -> tuple[int, int, int]:
    """(length in words, its exponent, hash functions) of the least filter of 2..2048 words that keeps the rate for a beam; else of the largest.

    With as many hash functions as suit it, a filter of m bits for n entries
    needs m >= -n ln p / (ln 2)^2, which gives the exponent; as hash functions
    are whole, one power more can be needed.
    """
    entries = BITS_PER_ENTRY * beam
    least = -entries * math.log(LARGEST_RATE) / math.log(2) ** 2 / 32
    exponent = max(LEAST_EXPONENT, math.ceil(math.log2(max(least, 1))))
    hashes = lambda e: max(1, round(math.log(2) * 32 * 2**e / entries))
    kept = lambda e: hashes(e) * math.log1p(-math.exp(-hashes(e) * entries / (32 * 2**e))) < math.log(LARGEST_RATE)
    exponent = min(MOST_EXPONENT, exponent if kept(exponent) else exponent + 1)
    return 2**exponent, exponent, hashes(exponent)
