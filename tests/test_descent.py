import numpy as np
import pandas as pd
import pytest

from latticevec.operators import descent, knn, metrics
from latticevec.plans.config import SearchConfig
from latticevec.plans.index import VectorIndex


def table(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "vec": [list(map(float, v)) for v in x]}), "id long, vec array<float>").repartition(3)


def lists(graph):
    return {r["id"]: list(r["neighbors"]) for r in graph.collect()}


def share(got, want):
    return np.mean([len(set(got[i]) & set(want[i])) / len(want[i]) for i in want])


def test_descent_finds_most_of_the_exact_graph(spark, monkeypatch):
    monkeypatch.setattr(descent, "WINDOW", 64)
    draw = np.random.default_rng(3)
    base = table(spark, draw.standard_normal((40, 12))[draw.integers(0, 40, 1500)] * 2 + draw.standard_normal((1500, 12)))
    want, got = lists(knn.knn_graph(base, 10)), lists(descent.descent_graph(base, 10))
    assert share(got, want) >= 0.95
    assert all(len(set(v)) == 10 and i not in v for i, v in got.items())
    assert share(lists(descent.descent_graph(base, 10, rounds=0)), want) < 0.8  # what the rounds are for


def test_descent_of_rows_in_a_window_is_exact(spark):
    base = table(spark, np.random.default_rng(4).standard_normal((50, 6))).coalesce(1)
    assert share(lists(descent.descent_graph(base, 5)), lists(knn.knn_graph(base, 5))) >= 0.99


def test_descent_with_a_hub_and_equal_rows(spark, monkeypatch):
    """A third of all rows are equal; one row is near to all others, which are far from each other."""
    monkeypatch.setattr(descent, "WINDOW", 32)
    monkeypatch.setattr(descent, "PIECE", 8)
    x = np.concatenate([np.zeros((100, 8)), np.random.default_rng(5).standard_normal((200, 8)) * 9])
    got = lists(descent.descent_graph(table(spark, x), 6))
    assert len(got) == 300 and all(len(set(v)) == 6 and i not in v for i, v in got.items())
    assert all(j < 100 for i in range(100) for j in got[i])


def test_descent_of_odd_rows(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0]), (2, [2.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [])]
    base = spark.createDataFrame(rows, "id long, vec array<double>")
    assert lists(descent.descent_graph(base, 2)) == lists(knn.knn_graph(base, 2))
    assert lists(descent.descent_graph(base.limit(0), 2)) == {}
    assert lists(descent.descent_graph(base.where("id = 1"), 2)) == {}


def test_index_with_a_graph_by_descent(spark):
    base = table(spark, np.random.default_rng(6).standard_normal((300, 12)))
    asked = base.where("id < 30").withColumnRenamed("id", "qid")
    index = VectorIndex.build(base, SearchConfig(dims=12, degree=12, n_candidates=64, topk=10, point_ratio=0.1, rerank=True, graph="descent"))
    assert metrics.recall(index.search(asked), knn.exact_knn(base, asked, 10), 10).first()["recall"] > 0.85
    with pytest.raises(ValueError, match="graph"):
        SearchConfig(graph="none")
