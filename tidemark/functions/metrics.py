"""Drift metrics as aggregate expressions over a paired histogram.

A paired histogram has a row per (column, bin) with `bl` and `rt`, the counts of baseline and runtime, and their sizes `bl_n`
and `rt_n`. Empty bins must be there: the floor EPS gives them a share. `with_shares` adds what the metrics read; then one
aggregation over the histogram gives all metrics asked for."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..enums import CategoricalMetric, ColumnClass, ContinuousMetric, Named

EPS = 1e-12


def share(count: Column, size: Column) -> Column:
    return F.greatest(count / (size + EPS), F.lit(EPS))


def with_shares(pairs: DataFrame, by: Sequence[str], cumulate: bool) -> DataFrame:
    """Adds p, q and expected counts; with `cumulate`, also the gap of the running sums in order of `bin`, and bins per column.

    The window runs over histogram rows, never over data rows."""
    bl, rt, bl_n, rt_n = (F.col(c) for c in ("bl", "rt", "bl_n", "rt_n"))
    pooled = (bl + rt) / (bl_n + rt_n + EPS)
    pairs = pairs.withColumns({"p": share(bl, bl_n), "q": share(rt, rt_n), "bl_expected": F.greatest(bl_n * pooled, F.lit(EPS)), "rt_expected": F.greatest(rt_n * pooled, F.lit(EPS))})
    if cumulate:
        keys = list(by) or [F.lit(0)]
        running = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        pairs = pairs.withColumn("gap", F.abs(share(F.sum("bl").over(running), bl_n) - share(F.sum("rt").over(running), rt_n)))
        pairs = pairs.withColumn("n_bins", F.count("*").over(Window.partitionBy(*keys)))
    return pairs


def _entropy_terms() -> Column:
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    return F.sum(0.5 * p * F.log(p / m) + 0.5 * q * F.log(q / m)) / math.log(2)


def _interior() -> Column:
    """Mean distance of the shares over the bins between the first and the last."""
    inside = (F.col("bin") >= 1) & (F.col("bin") <= F.col("n_bins") - 2)
    return F.coalesce(F.sum(F.when(inside, F.abs(F.col("p") - F.col("q")))), F.lit(0.0)) / F.max(F.greatest(F.col("n_bins") - 2, F.lit(1)))


def _chi_squared() -> Column:
    return F.sum(F.pow(F.col("bl") - F.col("bl_expected"), 2) / F.col("bl_expected") + F.pow(F.col("rt") - F.col("rt_expected"), 2) / F.col("rt_expected"))


def _g_test() -> Column:
    term = lambda seen, expected: seen * F.log(F.greatest((seen + EPS) / expected, F.lit(EPS)))
    return 2 * F.sum(term(F.col("bl"), F.col("bl_expected")) + term(F.col("rt"), F.col("rt_expected")))


def metric_columns(column_class: ColumnClass) -> dict[str, Column]:
    """Aggregate expression of each metric of a class."""
    p, q = F.col("p"), F.col("q")
    common = {
        "JensenShannon": _entropy_terms(),
        "PopulationStabilityIndex": F.sum((p - q) * F.log(p / q)),
        "KullbackLeibler": F.sum(p * F.log(F.greatest(p / q, F.lit(EPS)))),
        "Hellinger": F.sqrt(0.5 * F.sum(F.pow(F.sqrt(p) - F.sqrt(q), 2))),
    }
    if column_class is ColumnClass.CONTINUOUS:
        return common | {"WassersteinDistance": _interior(), "KolmogorovSmirnov": F.max("gap")}
    return common | {"WassersteinDistance": 0.5 * F.sum(F.abs(p - q)), "ChiSquared": _chi_squared(), "GTest": _g_test()}


def drift_rows(pairs: DataFrame, column_class: ColumnClass, metrics: Sequence[Named], by: Sequence[str] = ()) -> DataFrame:
    """(by..., metric, drift_magnitude): a row per metric asked for, in that order, repeats included. One aggregation."""
    chosen = [m.value for m in metrics]
    columns = metric_columns(column_class)
    ready = with_shares(pairs, by, column_class is ColumnClass.CONTINUOUS)
    wide = ready.groupBy(*by).agg(*[columns[m].alias(m) for m in dict.fromkeys(chosen)])
    listed = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(m).alias("metric"), F.col(m).alias("drift_magnitude")) for k, m in enumerate(chosen)])
    return wide.select(*by, F.explode(listed).alias("x")).select(*by, "x.position", "x.metric", "x.drift_magnitude")


def evaluate(bl: Sequence[float], rt: Sequence[float], bl_n: float, rt_n: float, metric: Named) -> float:
    """A metric of two count vectors on the driver, for histograms that are already there (streams, restored profiles)."""
    r = lambda c, n: max(c / (n + EPS), EPS)
    p, q = [r(c, bl_n) for c in bl], [r(c, rt_n) for c in rt]
    name = metric.value
    if name == "PopulationStabilityIndex":
        return math.fsum((a - b) * math.log(a / b) for a, b in zip(p, q, strict=True))
    if name == "KullbackLeibler":
        return math.fsum(a * math.log(max(a / b, EPS)) for a, b in zip(p, q, strict=True))
    if name == "JensenShannon":
        return math.fsum(0.5 * a * math.log(2 * a / (a + b)) + 0.5 * b * math.log(2 * b / (a + b)) for a, b in zip(p, q, strict=True)) / math.log(2)
    if name == "Hellinger":
        return math.sqrt(0.5 * math.fsum((math.sqrt(a) - math.sqrt(b)) ** 2 for a, b in zip(p, q, strict=True)))
    if name == "KolmogorovSmirnov":
        gap, x, y = 0.0, 0.0, 0.0
        for a, b in zip(bl, rt, strict=True):
            x, y = x + a, y + b
            gap = max(gap, abs(r(x, bl_n) - r(y, rt_n)))
        return gap
    if name == "WassersteinDistance":
        if isinstance(metric, ContinuousMetric):
            return math.fsum(abs(a - b) for a, b in zip(p[1:-1], q[1:-1], strict=True)) / max(len(p) - 2, 1)
        return 0.5 * math.fsum(abs(a - b) for a, b in zip(p, q, strict=True))
    pooled = [(a + b) / (bl_n + rt_n + EPS) for a, b in zip(bl, rt, strict=True)]
    expected = [(max(bl_n * s, EPS), max(rt_n * s, EPS)) for s in pooled]
    if metric is CategoricalMetric.CHI_SQUARED:
        return math.fsum((a - e) ** 2 / e + (b - f) ** 2 / f for a, b, (e, f) in zip(bl, rt, expected, strict=True))
    return 2 * math.fsum(a * math.log(max((a + EPS) / e, EPS)) + b * math.log(max((b + EPS) / f, EPS)) for a, b, (e, f) in zip(bl, rt, expected, strict=True))
