import numpy as np
import pytest

from latticevec.llm import ann
from latticevec.llm.queries import QUERIES


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "q") for i, v in rows], "vec_id long, embedding array<float>, bucket string")


def brute(rows, queries, k):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for q, v in queries:
        scored = sorted((-float((np.array(v, np.float32).astype(float) * x).sum()), i) for i, x in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def recall(got, expected):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    return np.mean([len(found.get(q, set()) & {i for i, _ in v}) / len(v) for q, v in expected.items() if v])


def test_hadamard():
    h = ann.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8)) and set(np.round(np.abs(h * np.sqrt(8)), 9).ravel()) == {1.0}


@pytest.mark.parametrize(("even", "bucket"), [(True, 30), (False, 30), (True, 0.5), (False, 0.01)])
def test_recall_on_clusters(spark, monkeypatch, even, bucket):
    monkeypatch.setattr(ann, "FEW", 100)
    monkeypatch.setattr(ann, "BUCKET_ROWS", bucket)  # one, two and three rotations
    monkeypatch.setattr(ann, "GROUP_ROWS", 100)
    draw = np.random.default_rng(6)
    x = draw.normal(size=(30, 24))[draw.integers(0, 30, 1500)] + 0.4 * draw.normal(size=(1500, 24))
    x = x / np.linalg.norm(x, axis=1)[:, None] if even else x
    rows = list(enumerate(x.tolist()))
    queries = [r for r in rows if r[0] % 20 == 0]
    got = ann.every_twentieth(table(spark, rows), 10).collect()
    assert recall(got, brute(rows, queries, 10)) >= 0.9 and len(got) == 10 * len(queries)


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10, 15, 20, 21, 22, 30])
def test_few_rows_are_all_searched(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    x[n // 2] = -x[0]
    rows = [(20 * i + i % 2, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1)[:, None]).tolist())]
    expected = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = ann.every_twentieth(table(spark, rows)).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(q, k + 1, i) for q, v in expected.items() for k, (i, _) in enumerate(v)}


def test_queries_that_find_too_few_are_searched_exactly(spark, monkeypatch):
    monkeypatch.setattr(ann, "FEW", 100)
    monkeypatch.setattr(ann, "measured", lambda shape, *_: setattr(shape, "probes", 1) or shape)
    monkeypatch.setattr(ann, "BUCKET_ROWS", 0.05)
    x = np.random.default_rng(3).normal(size=(600, 32))
    rows = list(enumerate((x / np.linalg.norm(x, axis=1)[:, None]).tolist()))
    got = ann.every_twentieth(table(spark, rows), 20).collect()
    assert len(got) == 20 * 30 and recall(got, brute(rows, [r for r in rows if r[0] % 20 == 0], 20)) > 0.8


def test_order_and_rank_agree():
    draw = np.random.default_rng(0)
    for parts in ([16], [16, 4], [16, 8, 2]):
        shape = ann.Hash(16, 1.0, True, parts, tables=1)
        x = draw.normal(size=(6, 16))
        each = next(shape.turned(x, True))
        total = np.zeros((6, 1))
        for y in each:
            total = (total[:, :, None] + y[:, None, :]).reshape(6, -1)
        best = np.argsort(-total, axis=1)
        for most in (1, 7, 30):
            assert (np.sort(shape.order(each, most), axis=1) == np.sort(best[:, :most], axis=1)).all()
        q = np.repeat(np.arange(6), 5)
        bucket = draw.integers(0, shape.size, 30)
        assert shape.rank(each, q, bucket).tolist() == [int(np.flatnonzero(best[i] == b)[0]) for i, b in zip(q, bucket, strict=True)]


def test_candidates_do_not_grow_with_the_table():
    """Clustered rows, as many clusters as rows allow: what a query looks at, as a number of rows, for ten times the rows."""
    looked = []
    for n in (8_000, 80_000):
        draw = np.random.default_rng(1)
        centres = draw.normal(size=(n // 40, 64))
        x = centres[np.arange(n) % len(centres)] + 0.35 * draw.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        q = np.arange(0, n, n // 50)[:50]
        near = np.argsort(-(x[q] @ x.T), axis=1)[:, 1:21]
        shape = ann.Hash(64, 1.0, True, ann.widths(n, 64))
        shape = ann.measured(shape, x[q], np.repeat(np.arange(50), 20), x[near.ravel()], 0.93)
        assert shape.recall >= 0.93
        buckets, found = shape.buckets(x), 0
        for t, each in enumerate(shape.turned(x[q], True)):
            found += np.bincount(buckets[:, t], minlength=shape.size)[shape.order(each, shape.probes)].sum()
        looked.append(found / len(q))
    assert looked[0] < 0.1 * 8_000 and looked[1] < 1.5 * looked[0]


def test_query_finds_what_brute_force_finds(spark, sf_dir):
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    rows = list(zip(data.vec_id.tolist(), data.embedding.tolist(), strict=True))
    queries = [r for r in rows if r[0] % 20 == 0]
    got = QUERIES["op3_nearest"](spark, sf_dir).collect()
    expected = brute(rows, queries, 20)
    assert recall(got, expected) >= 0.9 and len(got) == 20 * len(queries)
    exact = {(q, i): s for q, v in brute(rows, queries, 500).items() for i, s in v}
    for q in expected:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        assert all(r["score"] == pytest.approx(exact[q, r["vec_id"]], abs=1e-12) for r in mine)


def test_equal_vectors_tie_by_id_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    v, w = [0.1, 0.2, 0.3, 0.7], [0.3, -0.1, 0.5, 0.2]
    rows = [(i, v) for i in range(60)] + [(100 + i, w) for i in range(60)]
    got = ann.every_twentieth(table(spark, rows), 20).collect()
    for q in (0, 20, 40):
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for i in range(22) if i != q][:20]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, [1, 1]), (20, None), (40, []), (60, [0, 0]), (80, [None, 1]), (100, [nan, 1]), (120, [inf, 1]), (None, [1, 0]), (1, [1, 1]), (140, [2]), (7, [0, -3])]
    got = ann.every_twentieth(table(spark, rows)).collect()
    by = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in got}}
    assert by == {0: [(140, 2.0), (1, 1.0), (7, 0.0)], 140: [(0, 2.0), (1, 2.0), (7, 0.0)]}
    assert ann.every_twentieth(table(spark, rows[:1])).count() == 0
    assert ann.every_twentieth(table(spark, rows).limit(0)).count() == 0
    assert ann.every_twentieth(table(spark, rows[2:6])).count() == 0
