"""Benchmark decontamination: CGK embeddings, bit-sampling LSH, exact edit verification.

A document leaks a benchmark item if some run of its words is within an edit
distance of (1 - similarity) times the item's words. Words are runs of letters
and digits of the lower-cased text, so case, punctuation and line breaks don't
count.

Every word position starts an item-sized window. A window and an item are both
embedded by the CGK random walk: at step t the walk writes the word under it
and moves on by a random bit of (t, word). After an edit the walks of two
similar sequences soon meet again, so a small edit distance becomes a small
Hamming distance, and tables keyed by a few sampled steps of the walk collect
candidates. How many walks there are is settled by a simulation for each class
of similar lengths: edited copies of its items, at the largest distance that
counts, must be found at the target rate. Candidates are then verified by the
exact edit distance. Classes that miss the rate, or have few items for their
length, are searched exactly: the windows that hold enough words of an item are
aligned with it.

Windows that hold fewer benchmark words than any match must hold are not
embedded; that test loses no match. Items of fewer than five words allow no
edit; their words are looked up as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticevec.llm.common import KEY, mix64, row_key, segments, word_hashes

#: Items with fewer words say too little to be told from ordinary text: they are reported, but documents aren't dropped for them.
LEAST_WORDS = 5
#: Bytes of item texts that are indexed and broadcast at once; larger benchmarks take several passes.
SHARD_BYTES = 8_000_000
#: Steps that each table samples, and tables on each walk.
SAMPLED, TABLES = 2, 8
#: Words of one document scanned at once.
STRETCH = 1 << 18
#: Words of the longest items that are compared side by side, one matrix for many; longer ones take one bit vector each.
SIDE_BY_SIDE = 200


def words(texts: list[bytes], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each text followed by ``gap`` zeros, and where each text begins (with the end of all)."""
    parts, at, n = [], [0], 0
    blank = np.zeros(gap, np.uint64)
    for text in texts:
        parts.append(word_hashes(text))
        n += len(parts[-1])
        parts.append(blank)
        n += gap
        at.append(n)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(at)


@dataclass
class Index:
    """What a pass needs of the benchmark; its size follows the words of the benchmark, not the corpus's or the longest item's."""

    similarity: float
    ids: np.ndarray
    length: np.ndarray
    flat: np.ndarray  # vocabulary numbers of all items, one after the other
    begin: np.ndarray  # where each item begins in them
    vocabulary: np.ndarray
    bitmap: np.ndarray
    held: np.ndarray  # by a hash of item and word: False only if no item has that word
    classes: list[tuple[int, int, np.ndarray]] = field(default_factory=list)  # least and most words, items
    walks: dict[int, int] = field(default_factory=dict)  # by class; none for those searched exactly
    steps: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)  # (class, walk): sampled steps by table
    keys: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=dict)
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by words: keys and items
    recall: float = 0.0  # the least of all classes

    @property
    def reach(self) -> int:
        """Words behind the start of a window that can count."""
        return int(self.length.max() * 2) + 2 if len(self.length) else 2

    def allowed(self, n: np.ndarray | int) -> np.ndarray | int:
        return np.floor((1 - self.similarity) * n + 1e-9).astype(int)

    def item(self, k: int) -> np.ndarray:
        return self.flat[self.begin[k] : self.begin[k] + self.length[k]]

    def may_hold(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether an item may have a vocabulary word; never false where it has."""
        return self.held[_place(item, word, self.held)] & (word >= 0)

    @property
    def nbytes(self) -> int:
        parts = [self.flat, self.begin, self.length, self.vocabulary, self.bitmap, self.held, *self.steps.values()]
        return sum(x.nbytes for x in parts) + sum(x.nbytes for tables in self.keys.values() for table in tables for x in table)


def _place(item: np.ndarray, word: np.ndarray, table: np.ndarray) -> np.ndarray:
    h = item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (word.astype(np.int64) + 2).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(65 - len(table).bit_length())).astype(np.int64)


def number(index: Index, h: np.ndarray) -> np.ndarray:
    """Vocabulary numbers of word hashes: -1 for words of no item, -2 for gaps."""
    out = np.full(len(h), -1, np.int32)
    out[h == 0] = -2
    maybe = np.flatnonzero(index.bitmap[(h >> np.uint64(44)).astype(np.int64)])
    place = np.searchsorted(index.vocabulary, h[maybe])
    place[place == len(index.vocabulary)] = 0
    hit = index.vocabulary[place] == h[maybe]
    out[maybe[hit]] = place[hit]
    return out


def walk(h: np.ndarray, start: np.ndarray, wanted: np.ndarray, seed: int) -> dict[int, np.ndarray]:
    """Positions of the CGK walks from ``start`` at the wanted steps; a walk that reaches a gap stays there."""
    at, out, need = start.copy(), {}, set(wanted.tolist())
    bits = mix64(h, seed * 8)
    bits[h == 0] = 0
    for t in range(int(wanted.max()) + 1):
        if t and t % 64 == 0:
            bits = mix64(h, seed * 8 + t // 64)
            bits[h == 0] = 0
        if t in need:
            out[t] = at.copy()
        at += ((bits[at] >> np.uint64(t % 64)) & np.uint64(1)).view(np.int64)
    return out


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _table_keys(numbers: np.ndarray, places: dict[int, np.ndarray], steps: np.ndarray) -> np.ndarray:
    key = np.zeros(len(places[int(steps[0])]), np.uint64)
    for k, t in enumerate(steps):
        key += (numbers[places[int(t)]].astype(np.int64) + 3).astype(np.uint64) * _FACTORS[k]
    return key ^ (key >> np.uint64(29))


def _cell(key: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Where a key is looked up first: the high bits of its hash, as many as the table has."""
    return (key >> np.uint64(65 - len(seen).bit_length())).astype(np.int64)


def build(ids: list, texts: list[str], similarity: float = 0.8, target: float = 0.95, seed: int = 7, most_walks: int = 16) -> Index:
    """The index of some items; ``target`` is the rate at which copies at the largest edit distance must be found."""
    h, at = words([t.encode() for t in texts], 0)
    each = [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    keep = sorted((k for k in range(len(ids)) if len(each[k])), key=lambda k: len(each[k]))
    each, kept = [each[k] for k in keep], [ids[k] for k in keep]
    vocabulary = np.unique(np.concatenate(each)) if each else np.zeros(0, np.uint64)
    bitmap = np.zeros(1 << 20, bool)
    bitmap[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
    length = np.array([len(x) for x in each], int)
    flat = np.searchsorted(vocabulary, np.concatenate(each)).astype(np.int32) if each else np.zeros(0, np.int32)
    held = np.zeros(1 << max(12, (8 * len(flat)).bit_length()), bool)
    held[_place(np.repeat(np.arange(len(each)), length), flat, held)] = True
    index = Index(similarity, np.array(kept, np.int64), length, flat, np.cumsum(length) - length, vocabulary, bitmap, held)
    a = int(np.searchsorted(length, LEAST_WORDS))
    for n in np.unique(length[:a]):
        own = np.flatnonzero(length == n)
        key = _run_keys(flat, index.begin[own], int(n))
        order = np.argsort(key, kind="stable")
        index.short[int(n)] = key[order], own[order]
    while a < len(each):
        b = int(np.searchsorted(length, max(length[a] * 1.2, length[a]), "right"))
        index.classes.append((int(length[a]), int(length[b - 1]), np.arange(a, b)))
        a = b
    draw = np.random.default_rng(seed)
    for r in range(most_walks):
        for c, (least, _, _) in enumerate(index.classes):
            index.steps[c, r] = np.sort(np.array([draw.choice(max(SAMPLED, int(1.6 * least)), SAMPLED, replace=False) for _ in range(TABLES)]), axis=1)
    recalls, blank = [1.0], np.zeros(1, np.uint64)
    for c, (least, most, own) in enumerate(index.classes):
        if len(own) * 16 <= least:  # to align these costs less than one walk
            continue
        each_own, starts = _spread([each[k] for k in own], blank)
        # Edited copies of the class's items, 200 to 2,000, at the largest distance that counts, with other text behind them.
        chosen = np.resize(own, max(200, len(own))) if len(own) <= 2000 else draw.choice(own, 2000, replace=False)
        copies = []
        for k in chosen:
            x = list(each[k])
            for _ in range(int(index.allowed(len(x)))):
                p, kind = int(draw.integers(len(x))), int(draw.integers(3))
                x[p : p + (kind != 2)] = [] if kind == 0 else [np.uint64(draw.integers(1, 1 << 63))]
            copies.append(np.concatenate([np.array(x, np.uint64), draw.integers(1, 1 << 63, most, dtype=np.uint64)]))
        text, begin = _spread(copies, blank)
        numbers, found = number(index, text), np.zeros(len(chosen), bool)
        for r in range(most_walks):
            _add_walk(index, each_own, starts, c, r)
            place, item = _candidates(index, text, numbers, begin, [r], {c: np.arange(len(begin))})
            which = np.searchsorted(begin, place)
            found[which[item == chosen[which]]] = True
            if found.mean() >= target:
                index.walks[c] = r + 1
                recalls.append(float(found.mean()))
                break
        else:
            for r in range(most_walks):
                del index.keys[c, r]
    index.recall = min(recalls)
    for c, r in [x for x in index.steps if x not in index.keys]:
        del index.steps[c, r]
    return index


def _run_keys(numbers: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """A key of each run of n words."""
    key = np.zeros(len(start), np.uint64)
    for k in range(n):
        key = mix64(key ^ (numbers[start + k].astype(np.int64) + 3).astype(np.uint64), k)
    return key


def _spread(parts: list[np.ndarray], blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All parts, each followed by a gap, and where each begins."""
    begin = np.cumsum([0] + [len(x) + len(blank) for x in parts])[:-1]
    return np.concatenate([y for x in parts for y in (x, blank)]), begin.astype(np.int64)


def _add_walk(index: Index, flat: np.ndarray, starts: np.ndarray, c: int, r: int) -> None:
    numbers, own, tables = number(index, flat), index.classes[c][2], []
    places = walk(flat, starts, np.unique(index.steps[c, r]), r)
    for steps in index.steps[c, r]:
        key = _table_keys(numbers, places, steps)
        order = np.argsort(key)
        seen = np.zeros(1 << max(12, (16 * len(key)).bit_length()), bool)
        seen[_cell(key, seen)] = True
        tables.append((key[order], own[order].astype(np.int32), seen))
    index.keys[c, r] = tables


def _candidates(index: Index, h: np.ndarray, numbers: np.ndarray, alive: np.ndarray, walks: list[int], passing: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(window start, item) pairs that share a table's key, each once; passing: by class, which of ``alive`` count."""
    out, items = [], len(index.ids)
    for r in walks:
        on = [c for c in passing if (c, r) in index.keys and len(passing[c])]
        if not on:
            continue
        some = np.zeros(len(alive), bool)
        for c in on:
            some[passing[c]] = True
        rank = np.cumsum(some) - 1
        places = walk(h, alive[some], np.unique(np.concatenate([index.steps[c, r].ravel() for c in on])), r)
        for c in on:
            rows = rank[passing[c]]
            mine = {int(t): places[int(t)][rows] for t in np.unique(index.steps[c, r])}
            start = alive[passing[c]]
            for steps, (keys, own, seen) in zip(index.steps[c, r], index.keys[c, r], strict=True):
                key = _table_keys(numbers, mine, steps)
                maybe = np.flatnonzero(seen[_cell(key, seen)])
                low, high = np.searchsorted(keys, key[maybe], "left"), np.searchsorted(keys, key[maybe], "right")
                many = high - low
                if many.any():
                    which = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
                    out.append(np.repeat(start[maybe], many) * items + own[which])
    both = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return both // items, both % items


def _vector_distances(text: np.ndarray, item: np.ndarray, anywhere: bool) -> Iterator[int]:
    """The edit distance of an item to the runs of words that end at each word of a text: those from its first word, or the best of any.

    A column of the table of distances is kept as two bit vectors of its steps up and down.
    """
    n = len(item)
    where: dict[int, int] = {}
    for k, word in enumerate(item.tolist()):
        where[word] = where.get(word, 0) | 1 << k
    every, last, first = (1 << n) - 1, 1 << (n - 1), 0 if anywhere else 1
    up, down, score = every, 0, n
    for word in text.tolist():
        same = where.get(word, 0)
        across = (((same & up) + up) ^ up) | same | down
        right = down | (every & ~(across | up))
        left = up & across
        score += 1 if right & last else -1 if left & last else 0
        right, left = (right << 1 | first) & every, left << 1 & every
        same |= down
        up, down = left | (every & ~(same | right)), right & same
        yield score


def edit_distances(index: Index, numbers: np.ndarray, ends: np.ndarray, start: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each item to a run of words from its window's start, and that run's length; ends: where each word's text ends."""
    best, size = np.full(len(start), np.iinfo(np.int32).max, np.int32), np.zeros(len(start), int)
    for n in np.unique(index.length[item]):
        d, rows = int(index.allowed(n)), np.flatnonzero(index.length[item] == n)
        if n > SIDE_BY_SIDE:
            for k in rows:
                window = numbers[start[k] : min(start[k] + n + d, ends[start[k]])]
                scores = np.array([n, *_vector_distances(window, index.item(item[k]), False)])[n - d :]
                if len(scores):
                    best[k], size[k] = scores.min(), scores.argmin() + n - d
            continue
        for part in np.array_split(rows, max(1, len(rows) // 20_000)):
            # Words along the first axis: all candidates step together. What lies behind a text is a gap.
            window = numbers[np.minimum(start[part] + np.arange(n + d)[:, None], ends[start[part]])]
            mine, ramp = index.flat[index.begin[item[part]] + np.arange(n)[:, None]], np.arange(n + d + 1, dtype=np.int16)[:, None]
            now = np.repeat(ramp, len(part), axis=1)
            for i in range(n):
                new = np.empty_like(now)
                new[0] = i + 1
                np.minimum(now[:-1] + (window != mine[i]), now[1:] + np.int16(1), out=new[1:])
                new -= ramp
                now = np.minimum.accumulate(new, axis=0)
                now += ramp
            last = now[n - d :]
            size[part] = last.argmin(axis=0) + n - d
            best[part] = last.min(axis=0)
    return best, size


def aligned(index: Index, numbers: np.ndarray, ends: np.ndarray, start: np.ndarray, item: int, scratch: np.ndarray) -> list[int]:
    """For each run of neighbouring window starts, the first with the least edit distance, if that is allowed; exact.

    ``scratch`` is False for each vocabulary number, and is again afterwards.
    """
    n, out = int(index.length[item]), []
    d = int(index.allowed(n))
    scratch[index.item(item)] = True
    held = np.zeros(len(numbers) + 1, np.int32)
    np.cumsum(scratch[numbers], out=held[1:])
    scratch[index.item(item)] = False
    start = start[held[np.minimum(start + n, ends[start])] - held[start] >= n - d]
    for run in np.split(start, np.flatnonzero((np.diff(start) > n + d) | (ends[start[1:]] != ends[start[:-1]])) + 1) if len(start) else []:
        text = numbers[run[0] : min(run[-1] + n + d, ends[run[0]])][::-1]  # backwards, so that a match may end anywhere and its start is known
        scores = np.fromiter(_vector_distances(text, index.item(item)[::-1], True), np.int32, len(text))
        best = scores[len(text) - 1 - (run - run[0])]
        if best.min() <= d:
            out.append(int(run[best.argmin()]))
    return out


def search(index: Index, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, first word, words) for every text and item that it leaks: the least distance, the first such place."""
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    if not len(index.ids):
        return []
    scratch = np.zeros(len(index.vocabulary) + 2, bool)  # the last two stand for -2 and -1
    for a, b in segments(texts):
        h_all, at = words(texts[a:b], 1)
        ends_all = np.repeat(at[1:] - 1, np.diff(at))
        for first in range(0, len(h_all), STRETCH):  # windows of a stretch read on into the next
            h = np.append(h_all[first : first + STRETCH + index.reach], np.uint64(0))
            ends = np.append(np.minimum(ends_all[first : first + STRETCH + index.reach] - first, len(h) - 1), len(h) - 1)
            starts = min(STRETCH, len(h_all) - first)
            numbers = number(index, h)
            inside = np.zeros(len(h) + 1, np.int32)
            np.cumsum(numbers >= 0, out=inside[1:])
            passes, anywhere, place = [], np.zeros(starts, bool), np.arange(starts)
            for least, most, _ in index.classes:
                ok = (inside[np.minimum(place + least, ends[:starts])] - inside[:starts]) >= least - int(index.allowed(most))
                ok &= numbers[:starts] != -2  # windows begin at a word, not in the gap before a text
                passes.append(ok)
                anywhere |= ok
            found = [_short(index, numbers, ends, starts, n) for n in index.short]
            alive = np.flatnonzero(anywhere)
            if len(alive):
                rows = {c: np.flatnonzero(ok[alive]) for c, ok in enumerate(passes)}
                start, item = _candidates(index, h, numbers, alive, list(range(max(index.walks.values(), default=0))), rows)
                good = np.zeros(len(start), bool)
                for n in np.unique(index.length[item]):
                    same = np.flatnonzero(index.length[item] == n)
                    for part in np.array_split(same, max(1, len(same) * int(n) // 2_000_000)):
                        window = numbers[np.minimum(start[part][:, None] + np.arange(n), ends[start[part]][:, None])]
                        good[part] = index.may_hold(item[part][:, None], window).sum(axis=1) >= n - index.allowed(n)
                found.append((start[good], item[good]))
                sure = [(s, k) for c, (_, _, own) in enumerate(index.classes) if c not in index.walks and len(rows[c]) for k in own for s in aligned(index, numbers, ends, alive[rows[c]], k, scratch)]
                found.append((np.array([s for s, _ in sure], np.int64), np.array([k for _, k in sure], np.int64)))
            start, item = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            distance, size = edit_distances(index, numbers, ends, start, item)
            for k in np.flatnonzero(distance <= index.allowed(index.length[item])):
                text = int(np.searchsorted(at, first + start[k], "right")) - 1
                where = (int(distance[k]), int(first + start[k] - at[text]), int(size[k]))
                key = (a + text, int(item[k]))
                if key not in out or where < out[key]:
                    out[key] = where
    return [(t, i, *v) for (t, i), v in sorted(out.items())]


def _short(index: Index, numbers: np.ndarray, ends: np.ndarray, starts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(window start, item): for each text and item of n words, up to four, the first place where the words may be it."""
    known = numbers >= 0
    start = np.flatnonzero(known[:starts])
    start = start[start + n <= ends[start]]
    keys, own = index.short[n]
    key = _run_keys(numbers, start, n)
    low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    many = high - low
    item = own[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
    start = np.repeat(start, many)
    _, first = np.unique(ends[start] * np.int64(len(index.ids)) + item, return_index=True)
    return start[first], item[first]


def _indexes(benchmark: DataFrame, item_id: str, item: str, similarity: float, target: float) -> Iterator[Index]:
    """One index for each shard of the benchmark, of a bounded size."""
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item).alias("text")).where("id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = -(-total // SHARD_BYTES)
    for k in range(shards):
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == k).orderBy("id", "text").collect()  # at most about SHARD_BYTES
        yield build([r["id"] for r in rows], [r["text"] for r in rows], similarity, target)


LEAK = "item_id long, distance int, n_words int, word_start int, word_count int"


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item: str = "text", similarity: float = 0.8, target: float = 0.95) -> DataFrame:
    """One row per document row and leaked item: doc_id, item_id, distance (edits of words), n_words (of the item), word_start, word_count (the best place in the document).

    Null and empty texts leak nothing; items that are null, lack an id or have
    no words can't be leaked, and those of fewer than five words allow no edit.
    Equal items are each reported. Rows without an id are searched, and repeated
    rows each give their rows. No items or no documents give an empty result.
    Other columns are ignored.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *row_key(doc_id, text), F.col(text).alias("__lv_text"))
    for index in _indexes(benchmark, item_id, item, similarity, target):
        shared = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                texts = ["" if t is None else t for t in batch.column("__lv_text").to_pylist()]
                found = search(index, [t.encode() for t in texts])
                take = pa.array([f[0] for f in found], pa.int64())
                columns = [batch.column(k).take(take) for k in range(3)]
                columns += [pa.array([int(index.ids[f[1]]) for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32())]
                columns += [pa.array([int(index.length[f[1]]) for f in found], pa.int32()), *[pa.array([f[k] for f in found], pa.int32()) for k in (3, 4)]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *KEY, "item_id", "distance", "n_words", "word_start", "word_count"])

        part = rows.mapInArrow(scan, f"doc_id long, __lv_key long, __lv_text_key long, {LEAK}")
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], f"doc_id long, __lv_key long, __lv_text_key long, {LEAK}")


def leak_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The public columns of :func:`leaks`."""
    return leaks(docs, benchmark, **options).drop(*KEY)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """The documents, all columns, that leak no item of ``least_words`` or more; documents without a leak are untouched."""
    bad = leaks(docs, benchmark, doc_id, text, **options).where(F.col("n_words") >= least_words).select(*KEY).distinct()
    rows = docs.select("*", *row_key(doc_id, text)).join(bad, KEY, "left_anti")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
