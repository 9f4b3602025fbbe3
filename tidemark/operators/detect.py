"""Batch drift of one column against its baseline, and one-call functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..enums import CategoricalMetric, ContinuousMetric, Named, QuantileType, metrics_of
from ..errors import EmptyRuntimeData
from ..functions.binning import bin_count, bin_edges, bin_of, summarise
from ..functions.metrics import drift_rows
from .baseline import CategoricalBaseline, ContinuousBaseline, quoted


class _Detector:
    """Stateless between calls: each call bins the candidate anew."""

    baseline: ContinuousBaseline | CategoricalBaseline

    def __init__(self, baseline, nan_as_null: bool = False) -> None:
        self.baseline, self.nan_as_null = baseline, nan_as_null

    @property
    def n_bins(self) -> int:
        return self.baseline.n_bins

    def _candidate(self, df: DataFrame, column: str) -> DataFrame:
        if self.nan_as_null and isinstance(df.schema[column].dataType, T.FloatType | T.DoubleType):
            df = df.select(F.when(~F.isnan(quoted(column)), quoted(column)).alias(column))
        return self.baseline.candidate_histogram(df.select(quoted(column).alias(column)), column)

    def _sizes(self, hist: DataFrame) -> DataFrame:
        """(rt_n, rt_nulls)."""
        null = self.baseline.is_null_key(hist)
        total = lambda which: F.coalesce(F.sum(F.when(which, F.col("rt"))), F.lit(0.0))
        return hist.agg(total(~null).alias("rt_n"), total(null).alias("rt_nulls"))

    def drift(self, df: DataFrame, column: str, metrics: Sequence[Named] | None = None) -> DataFrame:
        """Lazy: (position, metric, drift_magnitude, null_percentage), a row per metric asked for.

        Sizes leave nulls out; null_percentage is nulls over all rows. One pass over the candidate whatever the number of metrics.
        An empty candidate gives no meaningful rows here; `compute_drift` raises for it."""
        metrics = list(metrics or metrics_of(self.baseline.column_class))
        spark, b = df.sparkSession, self.baseline
        hist = self._candidate(df, column)
        pairs = b.paired(hist, spark).crossJoin(F.broadcast(self._sizes(hist)))  # one row, from the same exchange
        pairs = pairs.withColumn("bl_n", F.lit(b.sample_size - b.null_count))
        rows = drift_rows(pairs.withColumn("null_percentage", F.try_divide("rt_nulls", F.col("rt_n") + F.col("rt_nulls"))), b.column_class, metrics, ["null_percentage"])
        return rows.select("position", "metric", "drift_magnitude", "null_percentage")

    def compute_drift_multiple_criteria(self, df: DataFrame, column: str, metrics: Sequence[Named]) -> list[tuple[Named, float]]:
        """Eager; order and repeats of the request are kept."""
        return self._computed(df, column, metrics)[0]

    def compute_drift(self, df: DataFrame, column: str, metric: Named) -> float:
        return self._computed(df, column, [metric])[0][0][1]

    def compute_with_nulls(self, df: DataFrame, column: str, metrics: Sequence[Named]) -> tuple[list[tuple[Named, float]], float]:
        """Metrics and the share of nulls."""
        return self._computed(df, column, metrics)

    def _computed(self, df: DataFrame, column: str, metrics: Sequence[Named]) -> tuple[list[tuple[Named, float]], float]:
        rows = self.drift(df, column, metrics).orderBy("position").collect()
        if rows[0]["null_percentage"] is None:
            raise EmptyRuntimeData(f"{column}: no runtime rows")
        return [(m, r["drift_magnitude"]) for m, r in zip(metrics, rows, strict=True)], rows[0]["null_percentage"]


class ContinuousDrift(_Detector):
    @classmethod
    def fit(cls, df: DataFrame, column: str, quantile_type: QuantileType = QuantileType.FREEDMAN_DIACONIS, nullable: bool = True, **options) -> ContinuousDrift:
        return cls(ContinuousBaseline.fit(df, column, quantile_type, nullable), **options)

    def reset_baseline(self, df: DataFrame, column: str) -> None:
        """Fit anew, with the same bin rule."""
        self.baseline = ContinuousBaseline.fit(df, column, self.baseline.quantile_type, self.baseline.nullable)


class CategoricalDrift(_Detector):
    @classmethod
    def fit(cls, df: DataFrame, column: str, nullable: bool = True, **options) -> CategoricalDrift:
        return cls(CategoricalBaseline.fit(df, column, nullable), **options)

    def reset_baseline(self, df: DataFrame, column: str) -> None:
        self.baseline = CategoricalBaseline.fit(df, column, self.baseline.nullable)


def compute_drift_continuous_distribution(baseline: DataFrame, candidate: DataFrame, column: str, metrics: Sequence[ContinuousMetric], quantile_type: QuantileType = QuantileType.FREEDMAN_DIACONIS) -> list[float]:
    return [v for _, v in ContinuousDrift.fit(baseline, column, quantile_type).compute_drift_multiple_criteria(candidate, column, metrics)]


def compute_drift_categorical_distribution(baseline: DataFrame, candidate: DataFrame, column: str, metrics: Sequence[CategoricalMetric]) -> list[float]:
    return [v for _, v in CategoricalDrift.fit(baseline, column).compute_drift_multiple_criteria(candidate, column, metrics)]


def compute_drift_nullable_categorical_distribution(baseline: DataFrame, candidate: DataFrame, column: str, metrics: Sequence[CategoricalMetric]) -> tuple[list[float], float]:
    found, nulls = CategoricalDrift.fit(baseline, column).compute_with_nulls(candidate, column, metrics)
    return [v for _, v in found], nulls


#: Every aggregation runs in parallel, so the forms that ask for it are the plain ones.
compute_drift_categorical_distribution_par = compute_drift_categorical_distribution
compute_drift_nullable_categorical_distribution_par = compute_drift_nullable_categorical_distribution


def bin_dataset(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """(bin, n) with the given edges, empty bins included."""
    counts = df.groupBy(bin_of(quoted(column), edges).alias("bin")).agg(F.count("*").cast("double").alias("n"))
    bins = df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").fillna(0.0, ["n"])


def approximate_dataset(df: DataFrame, column: str, quantile_type: QuantileType = QuantileType.FREEDMAN_DIACONIS) -> DataFrame:
    """(bin, n) with bins by rule, from the true minimum and maximum."""
    single = isinstance(df.schema[column].dataType, T.FloatType)
    data = df.select(quoted(column).alias("value"))
    summary = summarise(data, "value", quantile_type, single)
    return bin_dataset(data, "value", bin_edges(summary.low, summary.high, bin_count(summary, quantile_type), single))
