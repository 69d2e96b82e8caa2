"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some 64-bit value lies
within r bits of both. So every distinct fingerprint emits all the variants
within r bits (2,081 of them for r = 2), equal variants meet, and fingerprints
that share one are linked.

Writing 2,081 rows per fingerprint would be most of the cost, so what is
shuffled is one row per fingerprint and *prefix* of its variants: a task owns
all variants that begin with its prefix, and makes them from the fingerprints
sent to it, a bounded slice of the variants at a time. Prefixes that too many
fingerprints share are made longer until none is, so a task's share is bounded
however alike the fingerprints are.

Everything within r bits of one variant is mutually within 2r bits, so a chain
through the fingerprints of a variant stands for all their pairs, and a task
sends on a spanning forest of its links only. No group becomes pairs.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticevec.llm.common import KEY, checkpoint, join_facts, row_key, utf8
from latticevec.llm.graph import connected_components, merge_labels

SEED = 42
#: Variants that a task sorts at once.
SLICE = 1 << 21
#: Fingerprints that a task takes, at most; on average half as many at most.
TASK_FINGERPRINTS = 1 << 20
#: Bits of the shortest prefix, and of each step by which one is made longer.
LEAST_PREFIX, STEP = 8, 4
_CHUNK = 1 << 16
_SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes, width: int = 4) -> int:
    """The 64-bit SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, ``width``-word shingles.

    Fewer words than ``width`` make one shingle; a text without words has fingerprint zero.
    """
    line = text.lower().translate(_SPACES).strip(b" ")
    if b"  " in line:
        line = re.sub(b"  +", b" ", line)
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(line)]])
    n = max(1, len(starts) - width + 1)
    digest, last = xxhash.xxh64_intdigest, ends[min(width, len(starts)) - 1 :]
    counts = np.zeros((8, 256), np.int64)
    for k in range(0, n, _CHUNK):
        pairs = zip(starts[k : min(n, k + _CHUNK)].tolist(), last[k : k + _CHUNK].tolist(), strict=True)
        h = np.array([digest(line[s:e], SEED) for s, e in pairs], "<u8")
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BITS).ravel()
    return sum(1 << int(i) for i in np.flatnonzero(ones * 2 > n))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, __lv_key, __lv_text_key, fp) per row; fp is the fingerprint as a signed long. Null text counts as empty."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [_signed(fingerprint(t, width)) for t in utf8(batch.column("__lv_text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fp, pa.int64())], ["doc_id", *KEY, "fp"])

    columns = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *row_key(doc_id, text), F.col(text).alias("__lv_text"))
    return columns.mapInArrow(scan, "doc_id long, __lv_key long, __lv_text_key long, fp long")


def _masks(bits: int, flips: int) -> np.ndarray:
    """All values of ``bits`` bits with at most ``flips`` set, by their number of set bits."""
    return np.array([sum(1 << i for i in c) for k in range(min(flips, bits) + 1) for c in itertools.combinations(range(bits), k)], np.uint64)


def _meet(fps: np.ndarray, used: np.ndarray, depth: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indexes that share a variant, for the variants whose first ``depth`` bits are settled at a cost of ``used`` flips."""
    left = 64 - depth
    volume = np.array([sum(math.comb(left, j) for j in range(radius - k + 1)) for k in range(radius + 1)])
    if volume[used].sum() > SLICE and left > 8:
        nibble = (fps >> np.uint64(left - 4)) & np.uint64(15)
        for prefix in range(16):
            cost = used + np.bitwise_count(nibble ^ np.uint64(prefix)).astype(np.int64)
            keep = np.flatnonzero(cost <= radius)
            if len(keep) > 1:
                for a, b in _meet(fps[keep], cost[keep], depth + 4, radius):
                    yield keep[a], keep[b]
        return
    low = fps & np.uint64((1 << left) - 1)
    values, owners = [], []
    for k in range(radius + 1):
        own = np.flatnonzero(used == k)
        masks = _masks(left, radius - k)
        values.append((low[own][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(own, len(masks)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value)
    value, owner = value[order], owner[order]
    same = np.flatnonzero(value[1:] == value[:-1])
    if len(same):
        pair = np.unique(owner[same].astype(np.uint64) << np.uint64(32) | owner[same + 1].astype(np.uint64))
        yield (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints that join the same ones as all pairs at ``distance`` or fewer bits do.

    ``fps`` has distinct longs in ``fp`` that are not null. ``distance`` must be even.
    """
    radius = distance // 2
    if distance % 2:
        raise ValueError("ball hashing meets in the middle of an even distance")
    count, bits = fps.count(), LEAST_PREFIX
    while bits < 32 and count * len(_masks(bits, radius)) > TASK_FINGERPRINTS // 2 * 2**bits:
        bits += STEP
    near = [int(m) for m in _masks(bits, radius)]
    top = F.shiftrightunsigned("fp", 64 - bits)
    sent = fps.select("fp", F.explode(F.array(*[top.bitwiseXOR(F.lit(m).cast("long")) for m in near])).alias("prefix"))
    parts: list[DataFrame] = []
    while count > TASK_FINGERPRINTS:  # else none can have too many
        full = checkpoint(sent.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TASK_FINGERPRINTS).select("prefix"))
        if full.isEmpty() or bits + STEP > 56:
            break
        # There are fewer of these than all rows by a factor of TASK_FINGERPRINTS.
        small = sent.join(F.broadcast(full), "prefix", "left_anti")
        parts.append(small.groupBy("prefix").applyInArrow(_owned(bits, distance), "a long, b long"))
        held = sent.join(F.broadcast(full), "prefix", "left_semi")
        longer = F.explode(F.sequence(F.shiftleft("prefix", STEP), F.shiftleft("prefix", STEP) + (1 << STEP) - 1))
        bits += STEP
        sent = held.select("fp", longer.alias("prefix")).where(F.bit_count(F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(F.col("prefix"))) <= radius)
    return reduce(DataFrame.unionAll, parts, sent.groupBy("prefix").applyInArrow(_owned(bits, distance), "a long, b long"))


def _owned(bits: int, distance: int) -> Callable[[tuple[pa.Scalar], pa.Table], pa.Table]:
    """What a task does for a prefix of so many bits: links among the fingerprints sent to it, a forest of them."""

    def owned(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        fp = np.sort(rows.column("fp").to_numpy().view(np.uint64))
        cost = np.bitwise_count((fp >> np.uint64(64 - bits)) ^ np.uint64(key[0].as_py())).astype(np.int64)
        label = np.arange(len(fp))
        for a, b in _meet(fp, cost, bits, distance // 2):
            close = np.bitwise_count(fp[a] ^ fp[b]) <= distance
            merge_labels(label, a[close], b[close])
        linked = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"a": fp[label[linked]].view(np.int64), "b": fp[linked].view(np.int64)})

    return owned


def components(prints: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, n, root, component_id) per distinct fingerprint: n rows have it, root stands for its component, component_id is the least doc_id there."""
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = connected_components(links(nodes.select("fp"), distance))
    nodes = checkpoint(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("weight"))
    return join_facts(nodes, least, "root", "fp").select("fp", "n", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id linked to it through any chain).

    Null or empty texts have fingerprint zero and link like any other. Rows
    without an id take part; component_id is null where no member has an id.
    Repeated rows stay. An empty table gives an empty result. Other columns are ignored.
    """
    prints = checkpoint(fingerprints(docs, doc_id, text, width).select("doc_id", "fp"))
    groups = components(prints, distance).select("fp", "component_id", F.col("n").alias("weight"))
    out = join_facts(prints.withColumn("__lv_n", F.monotonically_increasing_id()), checkpoint(groups), "fp", "__lv_n")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """The documents, all columns, with one row of each component: that of the least doc_id (any id before none).

    Of rows equal in id and text one stays.
    """
    prints = checkpoint(fingerprints(docs, doc_id, text, width))
    member = F.struct(F.col("doc_id").isNull().alias("none"), *KEY)
    groups = checkpoint(components(prints, distance).select("fp", "root", F.col("n").alias("weight")))
    keep = join_facts(prints, groups, "fp", "__lv_text_key").groupBy("root").agg(F.min(member).alias("m")).select("m.__lv_key", "m.__lv_text_key")
    rows = docs.select("*", *row_key(doc_id, text)).join(keep, KEY, "left_semi")
    one = Window.partitionBy(*KEY).orderBy(F.col(text))
    return rows.withColumn("__lv_n", F.row_number().over(one)).where("__lv_n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
