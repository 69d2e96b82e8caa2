import pytest

import __spark_entry__ as entry
from latticevec.plans.oracles import ORACLE_SQL
from latticevec.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, sf_dir, same):
    same(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "rank", "id", "dist"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_beam_finds_most_neighbours(spark, sf_dir):
    assert QUERIES["beam_recall"](spark, sf_dir).first()["recall"] > 0.85


def test_small_side_is_broadcast_and_top_k_is_pushed_below_the_shuffle(spark, sf_dir):
    plan = QUERIES["knn_exact"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_without_the_corpus_operators_or_their_libraries(monkeypatch):
    """The other queries don't need them: neither the folder nor a library that only they import."""
    import importlib
    import sys

    for hidden in ("public_tokenizers", "latticevec.llm", "corpus_pipeline"):
        with monkeypatch.context() as m:
            for name in [n for n in sys.modules if n.startswith(("latticevec.llm", "corpus_pipeline"))]:
                m.delitem(sys.modules, name)
            m.setitem(sys.modules, hidden, None)
            alone = importlib.reload(entry)
            assert set(alone.queries()) == set(QUERIES) and set(alone.oracle_sql()) == set(ORACLE_SQL)
    importlib.reload(entry)


def test_points_are_looked_up_without_a_nested_loop(spark, sf_dir):
    for name in ("point_in_box", "box_entry_with_fallback"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "BroadcastHashJoin" in plan


def test_vector_files_keep_any_ids_and_single_precision(spark, tmp_path, same):
    """0.29 and 0.57 times 100 are whole numbers in single precision, and less in double; ids have gaps, and one stands twice."""
    import duckdb

    rows = [(7 + 100 * i, [0.29, -0.57, 0.5, i / 8], 0) for i in range(9)] + [(107, [1.0, 0.29, 0.25, 0.58], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    same(QUERIES["vector_files"](spark, str(tmp_path)).toPandas(), con.execute(ORACLE_SQL["vector_files"]).df())
