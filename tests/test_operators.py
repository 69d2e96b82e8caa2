import numpy as np
import pytest
from pyspark.sql import functions as F

from latticevec import streaming
from latticevec.functions.vec import subspace
from latticevec.operators import beam, boxes, knn, metrics, pca, tune
from latticevec.plans.config import SearchConfig
from latticevec.plans.index import VectorIndex
from latticevec.sources import logs
from latticevec.sources.store import Store


def vectors(spark, x, key="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} long, vec array<float>")


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(1).normal(size=(300, 12)).astype(np.float32)


def brute(x, q, k):
    d = ((q[:, None].astype(float) - x[None]) ** 2).sum(-1)
    return [np.lexsort((np.arange(len(x)), row))[:k].tolist() for row in d]


def lists(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["id"])
    return out


def test_exact_knn_by_broadcast_and_by_blocks(spark, cloud, monkeypatch):
    base, asked = vectors(spark, cloud), vectors(spark, cloud[:40], "qid")
    expected = dict(enumerate(brute(cloud, cloud[:40], 5)))
    assert lists(knn.exact_knn(base, asked, 5)) == expected
    for name, value in (("BROADCAST_BYTES", 0), ("QUERY_BLOCK", 7), ("BASE_BLOCK", 50)):
        monkeypatch.setattr(knn, name, value)
    assert lists(knn.exact_knn(base, asked, 5)) == expected


def test_more_neighbours_than_rows_and_no_rows(spark):
    base = vectors(spark, [[0, 0], [1, 0]])
    assert lists(knn.exact_knn(base, base, 5, qid="id")) == {0: [0, 1], 1: [1, 0]}
    assert lists(knn.exact_knn(base, base, 5, skip_self=True, qid="id")) == {0: [1], 1: [0]}
    assert knn.exact_knn(base.limit(0), base, 5, qid="id").count() == 0
    assert knn.exact_knn(base, base.limit(0), 5, qid="id").count() == 0


def test_odd_vectors(spark, cloud):
    """Null vectors, null or infinite components and rows without an id take no part; short vectors go on with zeros."""
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [nan, 0.0]), (5, [inf, 0.0]), (None, [0.0, 0.0]), (6, [1.0]), (7, [])]
    odd = spark.createDataFrame(rows, "id long, vec array<float>")
    asked = odd.select(F.col("id").alias("qid"), "vec")
    found = lists(knn.exact_knn(odd, asked, 3))
    assert found == {0: [0, 6, 1], 1: [1, 0, 6], 6: [0, 6, 1], 7: [7, 0, 6]}
    start = spark.createDataFrame([(q, 1) for q in (0, 2, 6)], "qid long, id long")
    graph = knn.knn_graph(odd, 3)
    expected = {0: [0, 6, 1], 6: [0, 6, 1]}
    assert lists(beam.search(asked, odd, graph, start, 3)) == expected
    used = odd.where("id in (0, 1, 6, 7)")
    assert lists(beam.by_joins(used.select(F.col("id").alias("qid"), "vec"), used, graph, start, 3).select("qid", "rank", "id", "dist")) == expected
    assert pca.fit(odd).mean.tolist() == [0.6, 0.2]
    assert pca.transform(odd, pca.fit(odd), 2).count() == 5  # the row without an id has a vector


def test_lookup_by_cells_equals_all_comparisons(spark):
    draw = np.random.default_rng(8)
    lo = draw.normal(size=(300, 3))
    hi = lo + draw.choice([0.0, 0.01, 0.3, 4.0], (300, 1)) * draw.uniform(size=(300, 3))
    p = np.concatenate([draw.normal(size=(400, 3)), lo[:50], hi[50:100], (lo + hi)[:50] / 2])
    shape = "box_id int, lo struct<x:double,y:double,z:double>, hi struct<x:double,y:double,z:double>"
    made = spark.createDataFrame([(k, tuple(map(float, a)), tuple(map(float, b))) for k, (a, b) in enumerate(zip(lo, hi, strict=True))], shape)
    points = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)] + [(999, None, 0.0, 0.0)], "qid long, x double, y double, z double")
    inside = ((p[:, None] >= lo) & (p[:, None] <= hi)).all(axis=2)
    for limit in (boxes.BROADCAST_BYTES, 0):
        boxes.BROADCAST_BYTES, before = limit, boxes.BROADCAST_BYTES
        try:
            assert {tuple(r) for r in boxes.points_in_boxes(points, made).collect()} == set(zip(*map(list, np.nonzero(inside)), strict=True))
            one = {r["qid"]: r["box_id"] for r in boxes.box_of(points, made).collect()}
        finally:
            boxes.BROADCAST_BYTES = before
        assert one == {k: int(np.flatnonzero(row)[0]) if row.any() else 0 for k, row in enumerate(inside)} | {999: 0}
    assert boxes.points_in_boxes(points, made.limit(0)).count() == 0 and boxes.box_of(points, made.limit(0)).count() == len(p) + 1


def test_dense_numbers_and_offsets(spark):
    rows = spark.createDataFrame([(x,) for x in ["b", "a", None, "c", "a"] + [f"x{i:04d}" for i in range(500)]], "v string").repartition(5)
    got = {r["v"]: r["number"] for r in boxes.dense_numbers(rows, "v").collect()}
    assert got == {v: k for k, v in enumerate(["a", "b", "c"] + [f"x{i:04d}" for i in range(500)])}


def test_dimension_recalls_equal_searches(spark, cloud):
    base, asked = vectors(spark, cloud[:150]), vectors(spark, cloud[:20], "qid")
    truth = knn.exact_knn(base, asked, 5)
    got = {r["dim"]: r["recall"] for r in tune.dimension_recalls(base, asked, range(1, 13), 8, 5).collect()}
    assert sorted(got) == list(range(1, 13)) and got[12] == 1
    for d in (1, 4, 9):
        assert got[d] == pytest.approx(metrics.recall(knn.exact_knn(base, asked, 8, dims=d), truth, 5).first()["recall"])


def test_pca(spark, cloud):
    x = cloud * np.linspace(3, 0.1, 12, dtype=np.float32) + 5
    model = pca.fit(vectors(spark, x).repartition(3))
    assert np.allclose(model.rotation.T @ model.rotation, np.eye(12), atol=1e-9)
    assert (np.diff(model.eigenvalues) <= 1e-12).all()
    assert np.allclose(np.diag(model.eigenvalues), model.rotation.T @ np.cov(x.astype(float).T) @ model.rotation, atol=1e-6)
    assert model.ratio(12) == pytest.approx(1) and 0 < model.ratio(3) < 1
    out = pca.transform(vectors(spark, x), model, 4).orderBy("id").toPandas()
    assert np.allclose(np.stack(out["pca"]), (x - x.mean(axis=0)) @ model.rotation[:, :4], atol=1e-4)
    assert np.allclose(pca.PCA.from_df(model.to_df(spark)).rotation, model.rotation)
    with pytest.raises(ValueError, match="no vectors"):
        pca.fit(vectors(spark, x).limit(0))


CLOUDS = {
    "normal": np.random.default_rng(2).normal(size=(500, 3)),
    "equal points": np.zeros((40, 3)),
    "line": np.stack([np.arange(90.0), np.zeros(90), np.zeros(90)], axis=1),
    "ties": np.random.default_rng(3).integers(0, 3, (200, 3)).astype(float),
}


@pytest.mark.parametrize("name", sorted(CLOUDS))
def test_kd_leaves_hold_each_point_once(name):
    points = CLOUDS[name]
    leaves = boxes.kd_leaves(points, np.arange(len(points)), 16)
    assert sorted(np.concatenate([leaf.members for leaf in leaves])) == list(range(len(points)))
    for leaf in leaves:
        assert 0 < len(leaf.members) <= 16
        assert (points[leaf.members] >= leaf.low).all() and (points[leaf.members] <= leaf.high).all()


@pytest.mark.parametrize("name", sorted(CLOUDS))
def test_kd_boxes_level_by_level_are_the_same(spark, name, monkeypatch):
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(CLOUDS[name])], "id long, x double, y double, z double")
    here = boxes.kd_boxes(points, 40).orderBy("box_id").collect()
    monkeypatch.setattr(boxes, "LOCAL_POINTS", 0)
    there = boxes.kd_boxes(points, 40).orderBy("box_id").collect()
    assert here == there


def test_capacity_below_one_is_refused(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    with pytest.raises(ValueError, match="point_ratio"):
        boxes.kd_boxes(points, 0)


def test_box_lookup_ties_and_fallback(spark):
    made = spark.createDataFrame([(k, (lo,) * 3, (hi,) * 3, [k, 9]) for k, lo, hi in ((0, 0.0, 1.0), (1, 0.5, 2.0), (2, 0.5, 3.0))], "box_id int, lo struct<x:double,y:double,z:double>, hi struct<x:double,y:double,z:double>, members array<long>")
    points = spark.createDataFrame([(q, v, v, v) for q, v in ((1, 0.7), (2, 1.0), (3, 1.5), (4, 7.0))], "qid long, x double, y double, z double")
    assert {r["qid"]: r["box_id"] for r in boxes.box_of(points, made).collect()} == {1: 0, 2: 0, 3: 1, 4: 0}
    assert boxes.points_in_boxes(points, made).count() == 8
    entries = boxes.entries(boxes.box_of(points, made), made, 1)
    assert {(r["qid"], r["id"]) for r in entries.collect()} == {(1, 0), (2, 0), (3, 1), (4, 0)}
    wide = boxes.expand_boxes(made, 0.5).where("box_id = 0").first()
    assert wide["lo"]["x"] == -0.5 and wide["hi"]["z"] == 1.5


@pytest.mark.parametrize(("width", "max_iter"), [(1, 100), (3, 100), (8, 100), (4, 1), (4, 0)])
def test_beam_search_by_joins_is_the_same(spark, cloud, width, max_iter):
    base, asked = vectors(spark, cloud[:120]), vectors(spark, cloud[:9], "qid")
    graph = knn.knn_graph(base, 6)
    graph = graph.withColumn("neighbors", F.concat("neighbors", F.array(F.lit(120).cast("long"))))  # a sentinel
    entries = beam.random_entries(asked, 120, 5)
    a = beam.search(asked, base, graph, entries, 8, 16, width, max_iter)
    b = beam.by_joins(asked, base, graph, entries, 8, 16, width, max_iter).select("qid", "rank", "id", "dist")
    assert lists(a) == lists(b)
    assert all(len(set(v)) == len(v) for v in lists(a).values())


@pytest.mark.parametrize("linked", [True, False])
def test_a_beam_for_all_rows_is_exact_and_never_written_out(spark, cloud, linked, monkeypatch):
    """Also where no path leads from a query's box to other rows; a query hands on k rows, not all."""
    base, n = vectors(spark, cloud), len(cloud)
    graph = None if linked else spark.createDataFrame([(i, []) for i in range(n)], "id long, neighbors array<long>")
    index = VectorIndex.build(base, SearchConfig.algorithm(1, dims=8, degree=6, n_candidates=n, topk=5, search_width=4, point_ratio=0.1, rerank=True, max_iter=n), graph)
    sizes = []
    monkeypatch.setattr(beam, "ranked", lambda pairs, k: sizes.append(pairs.count()) or knn.ranked(pairs, k))
    found = lists(index.search(base.select(F.col("id").alias("qid"), "vec")))
    assert found == dict(enumerate(brute(cloud, cloud, 5)))
    assert sizes == [5 * n]


def test_paths_are_followed_to_their_end():
    graph = beam.Graph.of(np.array([2, 5, 7, 9, 11]), np.zeros((5, 1)), np.array([2, 5, 9, 11]), np.array([2, 1, 1, 0]), np.array([5, 4, 7, 9]))
    reached = lambda *seeds: graph.ids[graph.reached(np.array(seeds, np.int64))].tolist()
    assert [reached(0), reached(3), reached(2, 4), reached()] == [[2, 5, 7], [9], [7, 11], []]


def test_a_beam_for_all_rows_does_not_depend_on_what_fits_in_memory(spark, cloud, monkeypatch):
    """Rows that no path leads to are found on tables of any size."""
    base, n = vectors(spark, cloud), len(cloud)
    graph = spark.createDataFrame([(i, []) for i in range(n)], "id long, neighbors array<long>")
    index = VectorIndex.build(base, SearchConfig.algorithm(1, dims=8, degree=6, n_candidates=n, topk=5, search_width=4, point_ratio=0.1, rerank=True, max_iter=n), graph)
    monkeypatch.setattr(beam, "BROADCAST_BYTES", 0)
    assert lists(index.search(base.select(F.col("id").alias("qid"), "vec"))) == dict(enumerate(brute(cloud, cloud, 5)))


@pytest.mark.parametrize(("block", "at_once", "rounds"), [(32_768, 64, 32), (40, 3, 32), (40, 64, 1)])
def test_blocks_starts_at_once_and_rounds_change_no_result(spark, cloud, monkeypatch, block, at_once, rounds):
    """Queries with entries, with none, and with a start that isn't there; odd vectors, sentinels and no queries."""
    inf = float("inf")
    rows = [(i, r.tolist()) for i, r in enumerate(cloud[:150])] + [(150, cloud[3].tolist()), (151, None), (152, [inf]), (153, [None]), (None, [0.0]), (154, [1.0]), (155, [])]
    base = spark.createDataFrame(rows, "id long, vec array<float>")
    graph = knn.knn_graph(base, 4).withColumn("neighbors", F.concat("neighbors", F.array(F.lit(999).cast("long"), F.lit(151).cast("long"))))
    starts = spark.createDataFrame([(10 * s, [s, s + 70, 152, 999]) for s in range(7)] + [(80, [])], "start long, ids array<long>")
    asked = base.select(F.col("id").alias("qid"), "vec", (F.col("id") % 10 * 10).alias("start"))
    for name, value in (("BASE_BLOCK", block), ("STARTS", at_once), ("ROUNDS", rounds)):
        monkeypatch.setattr(beam, name, value)
    key = lambda df: [(r["qid"], r["rank"], r["id"], r["dist"]) for r in df.orderBy("qid", "rank").collect()]
    assert key(beam.whole(asked, base, graph, starts, 5)) == key(knn.exact_knn(base, asked, 5))
    assert beam.whole(asked.limit(0), base, graph, starts, 5).count() == 0
    assert beam.whole(asked, base.limit(0), graph, starts, 5).count() == 0


def test_paths_by_joins_are_those_in_memory(spark, cloud):
    base = vectors(spark, cloud)
    graph = knn.knn_graph(base, 2)
    seeds = {b: [b, (37 * b) % 300] for b in range(64)}
    entries = spark.createDataFrame([(i, b) for b, ids in seeds.items() for i in ids], "id long, bit int").select("id", F.expr("shiftleft(1L, bit)").alias("bits"))
    found = {r["id"]: r["bits"] for r in beam.reached(base.select("id"), graph, entries).collect()}
    memory = beam.Graph.collected(base, graph)
    for b, ids in seeds.items():
        assert [i for i in range(300) if found[i] >> b & 1] == np.flatnonzero(memory.reached(np.array(ids))).tolist()


def test_beam_as_long_as_the_table_is_exact(spark, cloud):
    base, asked = vectors(spark, cloud[:60]), vectors(spark, cloud[:5], "qid")
    graph = knn.knn_graph(base, 59)
    found = beam.search(asked, base, graph, beam.random_entries(asked, 60, 1), 10, 60)
    assert lists(found) == dict(enumerate(brute(cloud[:60], cloud[:5], 10)))


def test_queries_without_entries_have_no_result(spark, cloud):
    base, asked = vectors(spark, cloud[:20]), vectors(spark, cloud[:2], "qid")
    none = spark.createDataFrame([(0, 99)], "qid long, id long")
    assert beam.search(asked, base, knn.knn_graph(base, 3), none, 5).count() == 0


def test_random_entries_follow_the_generator(spark):
    asked = spark.createDataFrame([(3,)], "qid long")
    s, ids = 3 * 64, []
    for _ in range(6):
        s = (s * 1103515245 + 12345) % 2**32
        ids.append(s % 1000)
    assert {r["id"] for r in beam.random_entries(asked, 1000, 6).collect()} == set(ids)


@pytest.mark.parametrize("number", [0, 1, 2])
@pytest.mark.parametrize("rerank", [False, True])
def test_index(spark, cloud, number, rerank):
    config = SearchConfig.algorithm(number, dims=8, degree=12, n_candidates=64, topk=10, search_width=4, point_ratio=0.1, rerank=rerank)
    index = VectorIndex.build(vectors(spark, cloud), config)
    asked = vectors(spark, cloud[:30], "qid")
    found = index.search(asked)
    assert found.groupBy("qid").count().where("count <> 10").count() == 0
    got = metrics.recall(found, knn.exact_knn(vectors(spark, cloud), asked, 10), 10).first()["recall"]
    assert got > (0.85 if rerank or number == 0 else 0.4)


def test_index_is_read_from_its_store(spark, cloud, tmp_path):
    config = SearchConfig(dims=4, degree=4, n_candidates=16, topk=3, point_ratio=0.1)
    store = Store(str(tmp_path))
    first = lists(VectorIndex.build(vectors(spark, cloud), config, store=store).search(vectors(spark, cloud[:3], "qid")))
    again = VectorIndex.build(vectors(spark, cloud), config, store=store)
    assert lists(again.search(vectors(spark, cloud[:3], "qid"))) == first
    assert len(list(tmp_path.iterdir())) == 1


def test_config_is_checked():
    with pytest.raises(ValueError, match="principal"):
        SearchConfig(projected=False)
    with pytest.raises(ValueError, match="positive"):
        SearchConfig(dims=0)
    assert SearchConfig().k == 128
    assert SearchConfig().key("a") != SearchConfig().key("b") != SearchConfig(dims=3).key("b")


def test_recall_counts_short_lists_against_the_whole(spark):
    truth = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 1, 5), (1, 2, 7)], "qid long, rank int, id long")
    results = spark.createDataFrame([(0, 6), (0, 5), (1, 9), (1, 9)], "qid long, id long")
    assert metrics.recall(results, truth, 2).first()["recall"] == 0.5
    assert metrics.recall(results, truth, 1).first()["recall"] == 0.5
    assert metrics.candidate_report(results, truth, 2).first()["mean_candidates"] == 2.0


def test_training_sample_does_not_depend_on_partitions(spark, cloud):
    a = {r["id"] for r in tune.training_sample(vectors(spark, cloud), 20).collect()}
    assert a == {r["id"] for r in tune.training_sample(vectors(spark, cloud).repartition(7), 20).collect()} and len(a) == 20


def test_sweep():
    rows = tune.sweep(lambda a, b: {"sum": a + b}, {"a": [1, 2], "b": [3]}, repeats=2)
    assert [r["sum"] for r in rows] == [4, 5, 4, 5]


def test_log(spark, tmp_path):
    lines = ["time pca: 12.5 ms", "recall@10 = 0.95 ms", "noise", "time pca: 7.5 ms"]
    rows = logs.parse_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["stage"], r["ms"], r["recall"]) for r in rows] == [("pca", 12.5, None), ("recall@10", None, 0.95), ("pca", 7.5, None)]
    timer = logs.Timer("r1")
    with timer.stage("search"), timer.stage("walk"):
        pass
    assert [r[1] for r in timer.rows] == ["search/walk", "search"]
    timer.append(spark, str(tmp_path / "log"))
    timer.append(spark, str(tmp_path / "log"))
    kept = spark.read.json(str(tmp_path / "log"))
    assert kept.count() == 4
    logs.write_report(metrics.mean_over_repeats(kept.select("stage", "ms")), str(tmp_path / "avg"))
    assert spark.read.text(str(tmp_path / "avg")).count() == 2


def test_queries_from_a_stream(spark, cloud, tmp_path):
    config = SearchConfig.algorithm(0, degree=4, n_candidates=16, topk=3)
    index = VectorIndex.build(vectors(spark, cloud[:50]), config)
    vectors(spark, cloud[:6], "qid").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, vec array<float>").parquet(str(tmp_path / "in"))
    streaming.search_stream(index, stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert lists(got) == lists(index.search(vectors(spark, cloud[:6], "qid")))


def test_subspace_of_a_column(spark, cloud):
    row = vectors(spark, cloud[:1]).select(subspace(F.col("vec"), 2).alias("p")).first()["p"]
    assert np.allclose(list(row), cloud[0, 6:9])
