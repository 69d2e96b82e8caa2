"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticevec.lineage import checkpoint, shared_dir

__all__ = ["KEY", "checkpoint", "fold", "join_facts", "labelled_sample", "mix64", "row_key", "segments", "shared_dir", "span_hashes", "spans", "table", "utf8", "word_hashes", "word_mask"]

#: Text handled at once by the byte-level numpy scans; bounds their memory.
SEGMENT_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str, text: str) -> list[Column]:
    """Two non-null columns that identify a document: its id, and a hash of its text and of whether it has an id.

    Rows that share an id but not a text are different documents.
    """
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("__lv_key"),
        F.xxhash64(F.col(doc_id).isNull(), F.col(text)).alias("__lv_text_key"),
    ]


KEY = ["__lv_key", "__lv_text_key"]


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def mix64(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64 arrays."""
    h = h ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x5851F42D4C957F2D
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SEGMENT_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of one segment, equal for equal spans anywhere."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix64((sums[ends] - sums[starts]) * down[starts] + lengths)


def word_mask(data: np.ndarray) -> np.ndarray:
    """True at bytes of words: letters and digits, and any non-ASCII text but spaces and punctuation."""
    mask = _WORD_BYTES[data]
    lead = np.flatnonzero(data == 0xC2)  # U+0080 to U+00BF
    for k in range(2):
        mask[np.minimum(lead + k, len(data) - 1)] = False
    for second in (0x80, 0x81):  # U+2000 to U+207F
        lead = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == second))
        for k in range(3):
            mask[lead + k] = False
    return mask


_WORD_BYTES = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _WORD_BYTES[_a:_b] = True


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a UTF-8 text in their order, lower-cased; a part of bounded size at a time."""
    lower, parts, a = text.decode("utf-8", "replace").lower().encode("utf-8", "replace"), [], 0
    while a < len(lower):
        b = min(len(lower), a + SEGMENT_BYTES)
        while b < len(lower) and lower[b] not in b" \n\t":  # cut between words
            b += 1
        data = np.frombuffer(lower, np.uint8, b - a, a)
        parts.append(span_hashes(data, *spans(word_mask(data))))
        a = b
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id's text, modulo ``parts``; null for rows without an id."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, label, text) of up to ``most`` labelled ids, those of the least hashes, among the ``learn`` rows of the labels.

    Null ids and labels don't count; an id labelled twice takes its larger
    label, and of rows that share an id one counts, that of the least hash.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    ids = known.where(learn).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = rows.join(F.broadcast(ids), "doc_id")  # ``most`` rows of two numbers
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    return found.withColumn("__lv_n", F.row_number().over(first)).where("__lv_n = 1").select("doc_id", "label", "text")


#: Keys that count as heavy at most; a heavy key has more than this part of all rows.
HEAVY = 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` with the columns of ``facts``, one row for each key of theirs, whose ``weight`` is how many rows have the key.

    Rows without facts are left out. Keys with more than a thousandth of all
    rows, of which there are fewer than a thousand, are joined by broadcast, and
    their rows are dealt out by the column ``spread``, a long.
    """
    total = facts.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    names = [c for c in facts.columns if c not in (key, "weight")]
    heavy = facts.where(F.col("weight") > total // HEAVY).select(F.col(key).alias("__lv_heavy"), F.struct(*names).alias("__lv_facts"))
    light = facts.where(F.col("weight") <= total // HEAVY).select(F.col(key).alias("__lv_light"), F.lit(False).alias("__lv_is_heavy"), F.struct(*names).alias("__lv_others"))
    out = rows.join(F.broadcast(heavy), F.col(key) == F.col("__lv_heavy"), "left").withColumn("__lv_is_heavy", F.col("__lv_heavy").isNotNull())
    out = out.withColumn("__lv_light", F.when(F.col("__lv_is_heavy"), F.col(spread)).otherwise(F.col(key)))
    out = out.join(light, ["__lv_light", "__lv_is_heavy"], "left")
    both = F.coalesce("__lv_facts", "__lv_others")
    return out.where(both.isNotNull()).select(*rows.columns, *[both[c].alias(c) for c in names])


def segments(texts: list[bytes], limit: int = SEGMENT_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about ``limit`` bytes together, one text at least."""
    a, size = 0, 0
    for b, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield a, b
            a, size = b, 0
        size += len(text) + 1
    if a < len(texts):
        yield a, len(texts)
