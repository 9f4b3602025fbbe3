import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.enums import QuantileType as Q
from tidemark.errors import EmptyBaselineData, NaNValueError, TooManyBins
from tidemark.functions import binning as B


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"v {kind}")


CASES = {"1..5": (range(1, 6), 3, 3, 3), "0..99": (range(100), 5, 5, 7), "0..49": (range(50), 4, 4, 6), "constant": ([5.0] * 20, 3, 3, 5), "zero iqr": ([1, 1, 1, 1, 2], 3, 3, 3)}


@pytest.mark.parametrize("case", CASES)
def test_bin_counts(spark, case):
    values, *expected = CASES[case]
    df = frame(spark, values)
    for rule, n in zip((Q.FREEDMAN_DIACONIS, Q.SCOTT, Q.STURGES), expected, strict=True):
        assert B.bin_count(B.summarise(df, "v", rule, False), rule) == n


def test_sturges(spark):
    for values, n in ((range(8), 4), (range(2), 3)):
        assert B.bin_count(B.summarise(frame(spark, values), "v", Q.STURGES, False), Q.STURGES) == n


def test_edges_add_up():
    assert B.bin_edges(0, 99, 5) == [0, 19.8, 39.6, 59.400000000000006]
    assert B.bin_edges(1, 5, 3) == [1, 2.333333333333333]
    step = np.float32(1) / np.float32(7)
    e = np.float32(0.1)
    for found in B.bin_edges(0.1, 1.1, 7, single=True):
        assert found == float(e)
        e = np.float32(e + (np.float32(1.1) - np.float32(0.1)) / np.float32(7))
    assert step > 0


@pytest.mark.parametrize("edges", [[0.25, 0.5, 0.75], [5.0, 5.0], [1.0, 2.0, 10.0, 11.0], B.bin_edges(-3.7, 12.9, 61), [3.0]])
def test_bins_are_half_open(spark, edges):
    rng = np.random.default_rng(5)
    values = [*rng.uniform(edges[0] - 2, edges[-1] + 2, 300).tolist(), *edges, *np.nextafter(edges, -math.inf).tolist(), *np.nextafter(edges, math.inf).tolist(), math.inf, -math.inf, 1e300, -1e300]
    df = frame(spark, values)
    for value, found in df.select("v", B.bin_of(F.col("v"), edges).alias("b")).collect():
        assert found == sum(e <= value for e in edges), value
    odd = frame(spark, [math.nan, None]).select(B.bin_of(F.col("v"), edges).alias("b")).collect()
    assert [r["b"] for r in odd] == [0, None]


@pytest.mark.parametrize("values", ["normal", "ties", "heavy", "constant"])
def test_order_statistics_are_exact(spark, values):
    rng = np.random.default_rng(9)
    made = {"normal": rng.normal(size=20_000), "ties": rng.integers(0, 5, 20_000).astype(float), "heavy": rng.pareto(0.5, 20_000), "constant": np.full(20_000, 2.5)}[values]
    ranks = [0, 1, 4999, 5000, 10_000, 15_000, 19_998, 19_999]
    df = spark.createDataFrame([(float(x),) for x in made], "v double")
    expected = np.sort(made)[ranks].tolist()
    assert B.order_statistics(df, "v", ranks, len(made)) == expected
    assert B.order_statistics(df, "v", ranks, len(made), exact_rows=500) == expected


def test_errors(spark):
    for values in ([], [1.0], [None, 2.0, None]):
        with pytest.raises(EmptyBaselineData):
            B.summarise(frame(spark, values), "v", Q.STURGES, False)
    for odd in (math.nan, math.inf):
        with pytest.raises(NaNValueError):
            B.summarise(frame(spark, [1.0, odd, 3.0]), "v", Q.SCOTT, False)
    with pytest.raises(TooManyBins):
        df = frame(spark, [*range(100), 1e12])
        B.bin_count(B.summarise(df, "v", Q.FREEDMAN_DIACONIS, False), Q.FREEDMAN_DIACONIS)
