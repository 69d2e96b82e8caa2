import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticevec.functions import bits, vec

A, B = [[1, 2, 3], [4, 5, 6]], [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12]]


def one(spark, column, schema="v array<double>", row=([1.0, 2.0, 3.0],)):
    return spark.createDataFrame([row], schema).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("alpha", "beta", "expected"), [(1, 0, [[38, 44, 50, 56], [83, 98, 113, 128]]), (2, 1, [[77, 90, 103, 116], [171, 202, 233, 264]])])
def test_gemm(spark, alpha, beta, expected):
    rows = [(k, [float(x) for x in A[k]], [float(4 * k + j + 1) for j in range(4)]) for k in range(2)]
    out = spark.createDataFrame(rows, "k int, v array<double>, c array<double>").select("k", vec.gemm(F.col("v"), B, alpha, beta, F.col("c")).alias("o")).orderBy("k").collect()
    assert [r["o"] for r in out] == expected


def test_distances_and_slices(spark):
    v = F.col("v")
    assert one(spark, vec.squared_l2(v, vec.vector([1, 0, 0]))) == 13.0
    assert one(spark, vec.truncated_l2(v, vec.vector([0, 0, 9]), 2)) == 5.0
    assert one(spark, vec.dot(v, v)) == 14.0
    assert one(spark, vec.leading(v, 2)) == [1.0, 2.0]
    assert one(spark, vec.subtract(v, vec.vector([1, 1, 1]))) == [0.0, 1.0, 2.0]
    assert tuple(one(spark, vec.subspace(v, 0))) == (1.0, 2.0, 3.0)
    assert tuple(one(spark, vec.subspace(v, 1))) == (None, None, None)
    assert one(spark, vec.project(v, [1, 1, 1], [[1], [1], [1]])) == [3.0]
    assert one(spark, vec.quantised(v, 100.0)) == [100, 127, 127]
    assert one(spark, vec.squared_l2(v, v), row=(None,)) is None


@pytest.mark.parametrize(("n", "power"), [(1, 1), (2, 2), (3, 4), (64, 64), (65, 128), (1000, 1024)])
def test_next_power_of_two(spark, n, power):
    assert one(spark, vec.next_power_of_two(F.lit(n))) == power


def test_integer_arithmetic_does_not_overflow(spark):
    xs = [0, 1, 12345, bits.WORD - 1, 2654435769]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    for factor in bits.MULTIPLIERS:
        assert [r[0] for r in df.select(bits.times_mod(F.col("x"), factor)).collect()] == [x * factor % bits.WORD for x in xs]

    def slot(x, h):
        x ^= x >> 16
        x = x * bits.MULTIPLIERS[2 * h] % bits.WORD
        x ^= x >> 13
        x = x * bits.MULTIPLIERS[2 * h + 1] % bits.WORD
        return (x ^ x >> 16) % 16384

    for h in range(3):
        assert [r[0] for r in df.select(bits.filter_slot(F.col("x"), h)).collect()] == [slot(x, h) for x in xs]


def test_filter_shape():
    words, exponent, hashes = bits.filter_shape(128)
    assert words == 2**exponent and hashes >= 1
    assert bits.filter_shape(10**9)[:2] == (2048, 11)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40), st.integers(1, 12), st.integers(1, 5), st.integers(0, 3))
def test_nearest_in_block_equals_brute_force(n, k, dims, ties):
    draw = np.random.default_rng(n * 100 + k)
    x = np.repeat(draw.integers(0, 3, (n, dims)), ties + 1, axis=0).astype(float)
    ids = draw.permutation(len(x))
    q = x[:7]
    d, who = vec.nearest_in_block(q, x, ids, k)
    for i in range(len(q)):
        all_d = ((q[i] - x) ** 2).sum(axis=1)
        order = np.lexsort((ids, all_d))[:k]
        assert who[i][: len(order)].tolist() == ids[order].tolist()
        assert (who[i][len(order) :] == -1).all()
