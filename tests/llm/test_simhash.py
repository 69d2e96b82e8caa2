import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from latticevec.llm import graph, simhash
from latticevec.llm.common import join_facts
from latticevec.llm.graph import connected_components


def slow_fingerprint(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids, distance=4):
    """Brute force over all pairs."""
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                label[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aAbZé \t\n\x0b\x0c\r\x1c\u00a0\u0130x.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_repeated_shingles_count_each_time():
    text = "a b c d " * 50 + "e f g h i j"
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize(("limit", "most"), [(1 << 21, 1 << 20), (3000, 1 << 20), (1 << 21, 40)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, limit, most):
    monkeypatch.setattr(simhash, "SLICE", limit)
    monkeypatch.setattr(simhash, "TASK_FINGERPRINTS", most)  # 40: prefixes are made longer, those of the centres several times
    monkeypatch.setattr(simhash, "LEAST_PREFIX", 8 if most > 40 else 4)
    draw = np.random.default_rng(4)
    centres = [int(x) for x in draw.integers(0, 1 << 63, 12)] + [0, (1 << 64) - 1]
    fps = {c for c in centres}
    for c in centres:
        for _ in range(12):
            x = c
            for _ in range(int(draw.integers(1, 7))):
                x ^= 1 << int(draw.integers(64))
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(df)).collect()}
    got = [roots.get(x, x) for x in signed]
    expected = components(fps, list(range(len(fps))))
    assert len(set(zip(got, expected, strict=True))) == len(set(got)) == len(set(expected))


@pytest.mark.parametrize("most", [100_000, 20, 0])
def test_components_of_shapes(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "TASK_EDGES", most)
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(1000, 1000 + i) for i in range(1, 30)]
    odd = [(5000, 5000), (None, 3), (7000, 7001), (7001, 7000)]
    out = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain + star + odd, "a long, b long")).collect()}
    assert len({out[i] for i in range(41)}) == len({out[1000 + i] for i in range(30)}) == 1
    assert len(set(out.values())) == 3 and out[7000] == out[7001]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_heavy_keys_are_joined_whole(spark):
    rows = spark.range(3000).selectExpr("id", "if(id < 2500, 7, id) AS k")
    facts = spark.createDataFrame([(7, 2500, "a"), (2600, 1, None), (2601, 1, "c"), (9999, 0, "d")], "k long, weight long, v string")
    got = {(r["id"], r["k"], r["v"]) for r in join_facts(rows, facts, "k", "id").collect()}
    assert got == {(i, 7, "a") for i in range(2500)} | {(2600, 2600, None), (2601, 2601, "c")}


def test_query_equals_brute_force(spark, sf_dir):
    from latticevec.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    got = QUERIES["op8_simhash"](spark, sf_dir).toPandas().set_index("doc_id")
    fps = [slow_fingerprint(t) for t in docs.text]
    expected = components(fps, docs.doc_id.tolist())
    assert got.loc[docs.doc_id, "fingerprint"].tolist() == [f"{x:016x}" for x in fps]
    assert got.loc[docs.doc_id, "component_id"].tolist() == expected


def test_odd_rows(odd_docs, no_docs):
    out = simhash.near_duplicates(odd_docs)
    assert out.count() == odd_docs.count()
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in out.collect()}
    assert by[1, "0" * 16] == by[2, "0" * 16] == by[3, "0" * 16] == by[None, "0" * 16] == 1
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_document_of_each_group_stays(odd_docs, no_docs):
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 4, 6, 6, 7, 8] and ids.count(None) == 1
    assert simhash.drop_near_duplicates(no_docs).count() == 0
