import random
import re

import numpy as np
import pytest

from latticevec.llm import decontam
from latticevec.llm.common import word_hashes
from latticevec.llm.queries import QUERIES

WORDS = [a + b for a in ("the", "on", "er", "th", "re", "ing") for b in ("an", "is", "of", "ta", "li", "mo", "su", "pe", "ka", "du")]


def text_of(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row


def brute(docs, items, similarity=0.8):
    """The least distance of each leaked (document, item)."""
    out = {}
    for i, doc in enumerate(docs):
        d = re.findall(r"\w+", doc.lower())
        for k, item in enumerate(items):
            x = re.findall(r"\w+", item.lower())
            most = int((1 - similarity) * len(x) + 1e-9)
            best = min((min(edits(x, d[s : s + len(x) + most])[len(x) - most :], default=99) for s in range(len(d))), default=99)
            if x and best <= most:
                out[i, k] = best
    return out


def changed(item, n, seed):
    draw, words = random.Random(seed), item.split()
    for _ in range(n):
        p = draw.randrange(len(words))
        kind = draw.randrange(3)
        words[p : p + (kind != 2)] = [] if kind == 0 else ["zzz" + str(draw.random())[2:6]]
    return " ".join(words)


def test_words_are_the_same_wherever_they_stand():
    a = word_hashes("Hello, WORLD! Éa “quoted” x".encode())
    b = word_hashes("x éa hello\nworld—quoted".encode())
    assert len(a) == len(b) == 5 and set(a) == set(b) and len(set(a)) == 5
    big = ("word%d " * 10) % tuple(range(10)) * 40_000
    assert len(np.unique(word_hashes(big.encode()))) == 10


def test_search_finds_edited_copies_and_nothing_else(spark, docs_of):
    items = [text_of(n, n) for n in (12, 15, 20, 30, 45, 60)] + ["too short item"]
    docs, planted = [text_of(200, 1000 + i) for i in range(30)] + ["", "\n", items[2]], {}
    for k in range(6):
        n = len(items[k].split())
        for share in (0, 0.1, 0.15):
            copy = changed(items[k], int(share * n), k)
            docs.append(f"{text_of(40, k)}. {copy.upper().replace(' ', ', ')}! {text_of(40, 99 + k)}")
            planted[len(docs) - 1, k] = share
    expected = brute(docs, items)
    assert set(planted) <= set(expected)
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(None, items[0]), (77, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.leak_report(docs_of(docs), benchmark).collect()}
    assert set(got) <= set(expected)
    assert all(got[p] == expected[p] for p in got)
    assert {p for p, share in planted.items() if share <= 0.1} <= set(got)
    assert len(got) >= 0.9 * len(expected)


def test_recall_at_the_largest_distance():
    items = [text_of(n, n) for n in range(20, 60)]
    index = decontam.build(list(range(len(items))), items)
    assert index.recall >= 0.95
    found = total = 0
    for seed in range(4):
        docs = [f"{text_of(30, 5 * seed + k)} {changed(t, int(0.2 * len(t.split())), 100 * seed + k)} {text_of(30, k)}" for k, t in enumerate(items)]
        found += sum(t == i for t, i, *_ in [(f[0], int(index.ids[f[1]])) for f in decontam.search(index, [d.encode() for d in docs])])
        total += len(docs)
    assert found >= 0.9 * total


def test_every_length_is_found():
    wide = lambda n, seed: " ".join(f"w{random.Random(seed * 10_000 + i).randrange(5000)}" for i in range(n))
    items = [wide(16, n) for n in range(300)] + [wide(300, n) for n in range(1000, 1020)] + [wide(1500, 7)]
    index = decontam.build(list(range(len(items))), items)
    assert index.recall >= 0.95 and len(index.classes) == 3 and 2 not in index.walks
    planted = list(range(300, 321))
    docs = [f"{text_of(30, k)} {changed(items[k], int(0.2 * len(items[k].split())), k)} {text_of(30, k + 1)}" for k in planted]
    found = {(f[0], f[1]) for f in decontam.search(index, [d.encode() for d in docs])}
    assert sum((i, k) in found for i, k in enumerate(planted)) >= 18 and (20, 320) in found


def test_a_class_that_misses_the_rate_is_searched_exactly():
    items = [text_of(n, n) for n in range(20, 40)]
    docs = [f"{text_of(30, k)} {changed(t, int(0.2 * len(t.split())), 50 + k)} {text_of(30, k)}" for k, t in enumerate(items)]
    index = decontam.build(list(range(len(items))), items, most_walks=0)
    assert not index.walks and index.recall == 1
    got = {f[:2]: f[2:] for f in decontam.search(index, [d.encode() for d in docs])}
    assert {k: v[0] for k, v in got.items()} == brute(docs, items)


def test_stretches_and_shards_change_nothing(spark, docs_of, monkeypatch):
    items = [text_of(n, n) for n in (15, 25, 40)]
    docs = [" ".join([text_of(97, 1), items[0], text_of(113, 2), items[1], text_of(55, 3), items[2], items[0], text_of(70, 4)])]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = lambda: sorted(map(tuple, decontam.leak_report(docs_of(docs), benchmark).collect()))
    whole = rows()
    assert len(whole) == 3 and all(r[2] == 0 for r in whole)
    monkeypatch.setattr(decontam, "SHARD_BYTES", 150)
    assert rows() == whole
    index = decontam.build([0, 1, 2], items)
    one = decontam.search(index, [docs[0].encode()])
    monkeypatch.setattr(decontam, "STRETCH", 64)
    assert decontam.search(index, [docs[0].encode()]) == one and len(one) == 3


def test_exact_passages_of_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_decontamination"](spark, sf_dir).collect()}
    exact = {(d, i) for d, t in zip(docs.doc_id, docs.text, strict=True) for i, x in zip(items.item_id, items.text, strict=True) if x in t}
    assert exact <= got
    expected = {(docs.doc_id[d], items.item_id[i]) for d, i in brute(docs.text.tolist()[:12], items.text.tolist())}
    assert {p for p in got if p[0] in set(docs.doc_id[:12])} == expected


def test_short_items_are_found_as_they_are(spark, docs_of):
    items = ["one two three four", "Alpha", "beta gamma", "beta gamma", "x y z"]
    docs = ["so ONE, two; three four.", "one two four three", "gamma beta", "alpha beta alpha", "beta", "gamma", "x y", "z"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["word_start"] for r in decontam.leak_report(docs_of(docs), benchmark).collect()}
    assert got == {(0, 0): 1, (3, 1): 0} and set(got) == set(brute(docs, items))
    assert decontam.drop_leaking(docs_of(docs), benchmark).count() == len(docs)
    assert decontam.drop_leaking(docs_of(docs), benchmark, least_words=1).count() == len(docs) - 2


def wide_text(n, seed):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 50_000, n))


def test_very_long_items():
    long = wide_text(50_000, 1)
    items = [long, wide_text(28_000, 2)] + [text_of(20, n) for n in range(40)]
    index = decontam.build(list(range(len(items))), items)
    docs = [changed(long, 9000, 3), wide_text(60_000, 4), " ".join(long.split()[:30_000]), "short " + items[5], wide_text(28_000, 5)] + ["word"] * 2000
    got = {f[:2]: f[2] for f in decontam.search(index, [d.encode() for d in docs])}
    assert (0, int(np.flatnonzero(index.ids == 0)[0])) in got
    assert {(t, int(index.ids[k])) for t, k in got if t in (0, 1, 2, 4)} == {(0, 0)}
    assert got[3, int(np.flatnonzero(index.ids == 5)[0])] == 0


def test_bit_vectors_equal_the_table_of_distances():
    draw = random.Random(2)
    for _ in range(40):
        item, text = (np.array([draw.randrange(4) for _ in range(draw.randrange(1, 90))]) for _ in range(2))
        assert list(decontam._vector_distances(text, item, False)) == edits(item.tolist(), text.tolist())[1:]
        best = [min(edits(item.tolist(), text[s : e + 1].tolist())[-1] for s in range(e + 2)) for e in range(min(len(text), 12))]
        assert list(decontam._vector_distances(text, item, True))[: len(best)] == best


def test_the_index_of_a_whole_shard_is_small():
    draw = np.random.default_rng(0)
    names = [f"term{k}" for k in range(100_000)]
    items = [" ".join(names[k] for k in draw.integers(0, len(names), n)) for n in draw.integers(5, 20, 80_000)]
    assert sum(map(len, items)) > 7_500_000
    assert decontam.build(list(range(len(items))), items).nbytes < 200_000_000


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "...")], [(1, "one two three four")]])
def test_nothing_to_leak(spark, odd_docs, rows):
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    assert decontam.leak_report(odd_docs, benchmark).count() == 0
    kept = decontam.drop_leaking(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_odd_rows(spark, odd_docs, no_docs):
    passage = " ".join(f"word{i % 977}" for i in range(500, 540))
    benchmark = spark.createDataFrame([(3, passage), (4, "no id here at all")], "item_id long, text string")
    got = decontam.leak_report(odd_docs, benchmark).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == [(0, 4), (4, 3), (5, 3)]
    kept = decontam.drop_leaking(odd_docs, benchmark)
    assert kept.count() == odd_docs.count() - 3 and kept.where("doc_id in (4, 5)").count() == 0
    assert decontam.leak_report(no_docs, benchmark).count() == 0
