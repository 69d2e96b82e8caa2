import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """A DuckDB connection with the tables of the smallest scale."""
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/sf0.001/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"


def rows_of(frame):
    """Sorted rows of a pandas frame, columns by name, with floats to six places."""
    import numpy as np

    def plain(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return tuple(plain(x) for x in v)
        if v is None or (isinstance(v, (float, np.floating)) and v != v):
            return "null"
        return round(float(v), 6) + 0.0 if isinstance(v, (float, np.floating)) else str(v)

    names = sorted(frame.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same():
    def check(got, expected):
        a, b = rows_of(got), rows_of(expected)
        assert a[0] == b[0]
        assert a[1] == b[1]

    return check
