"""Baselines of single columns: bins, counts and sizes, the same size whatever the data."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..enums import ColumnClass, QuantileType
from ..errors import EmptyBaselineData, InvalidDataShape
from ..functions.binning import LEAST_BINS, bin_count, bin_edges, bin_of, summarise_all
from ..sources.schema import class_of

#: Vocabularies up to this many values live on the driver and are broadcast; larger ones stay a DataFrame and are joined by shuffle.
LOCAL_VALUES = 100_000


#: Keys of nulls in candidate histograms.
NULL_BIN, NULL_KEY = -1, "n"


def text_key(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), value.cast("string")), F.lit(NULL_KEY))


def quoted(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


@dataclass
class ContinuousBaseline:
    """Fixed-width bins of a floating-point column. Nulls are counted apart (`sample_size` includes them)."""

    bin_edges: list[float]
    baseline_hist: list[float]
    sample_size: float
    quantile_type: QuantileType = QuantileType.FREEDMAN_DIACONIS
    null_count: float = 0.0
    nullable: bool = True

    column_class = ColumnClass.CONTINUOUS

    def __post_init__(self) -> None:
        if len(self.bin_edges) != len(self.baseline_hist) - 1 or len(self.baseline_hist) < LEAST_BINS:
            raise InvalidDataShape(f"{len(self.bin_edges)} edges and {len(self.baseline_hist)} bins")

    @classmethod
    def fit(cls, df: DataFrame, column: str, quantile_type: QuantileType = QuantileType.FREEDMAN_DIACONIS, nullable: bool = True) -> ContinuousBaseline:
        """A few aggregations over the column: range, quartiles if the rule needs them, counts per bin."""
        return cls.fit_all(df, {column: quantile_type}, nullable)[column]

    @classmethod
    def fit_all(cls, df: DataFrame, rules: dict[str, QuantileType], nullable: bool = True) -> dict[str, ContinuousBaseline]:
        """Baselines of several columns in the same few passes."""
        singles = {c: isinstance(df.schema[c].dataType, T.FloatType) for c in rules}
        summaries = summarise_all(df, rules, singles)
        edges = {c: bin_edges(s.low, s.high, bin_count(s, rules[c]), singles[c]) for c, s in summaries.items()}
        pairs = F.array(*[F.struct(F.lit(i).alias("column"), bin_of(quoted(c), e).alias("bin")) for i, (c, e) in enumerate(edges.items())])
        counts = df.select(F.explode(pairs).alias("x")).groupBy("x.column", "x.bin").agg(F.count("*").alias("n"))
        found = {(r[0], r[1]): float(r[2]) for r in counts.collect()}  # a row per column and bin
        out = {}
        for i, (c, e) in enumerate(edges.items()):
            s = summaries[c]
            out[c] = cls(e, [found.get((i, b), 0.0) for b in range(len(e) + 1)], float(s.rows), rules[c], float(s.rows - s.values), nullable)
        return out

    @property
    def n_bins(self) -> int:
        return len(self.baseline_hist)

    def key(self, value: Column) -> Column:
        return bin_of(value, self.bin_edges)

    def histogram(self, spark: SparkSession) -> DataFrame:
        """(bin, bl)."""
        return spark.createDataFrame(list(enumerate(self.baseline_hist)), "bin int, bl double")

    def candidate_histogram(self, df: DataFrame, column: str) -> DataFrame:
        """(bin, rt) with a row for each bin that has rows; bin -1 counts nulls. Combined map-side.

        The key is never null, so no filter on nulls is pushed below the aggregation and all readers share one scan."""
        return df.groupBy(F.coalesce(self.key(quoted(column)), F.lit(NULL_BIN)).alias("bin")).agg(F.count("*").cast("double").alias("rt"))

    @staticmethod
    def is_null_key(candidate: DataFrame) -> Column:
        return candidate["bin"] == NULL_BIN

    def paired(self, candidate: DataFrame, spark: SparkSession) -> DataFrame:
        """(bin, bl, rt) for all bins."""
        return self.histogram(spark).join(candidate, "bin", "left").fillna(0.0, ["rt"])

    def profile(self, spark: SparkSession) -> DataFrame:
        """(bin, low, high, n): the outer bins are open."""
        edges = [None, *self.bin_edges, None]
        rows = [(b, edges[b], edges[b + 1], n) for b, n in enumerate(self.baseline_hist)]
        return spark.createDataFrame(rows, "bin int, low double, high double, n double")


@dataclass
class CategoricalBaseline:
    """Counts per value, in sorted order, and an "other" bin, empty in the baseline, for values it has not seen.

    `counts` is the vocabulary (value, bl) as a DataFrame where it is too large for the driver; otherwise `values` and
    `baseline_hist` hold it."""

    values: list | None
    baseline_hist: list[float] | None
    sample_size: float
    null_count: float = 0.0
    nullable: bool = True
    value_type: T.DataType = field(default_factory=T.StringType)
    counts: DataFrame | None = None

    column_class = ColumnClass.CATEGORICAL

    def __post_init__(self) -> None:
        if self.counts is None and len(self.baseline_hist) - 1 != len(self.values):
            raise InvalidDataShape(f"{len(self.values)} values and {len(self.baseline_hist)} bins")

    @classmethod
    def fit(cls, df: DataFrame, column: str, nullable: bool = True, local_values: int = LOCAL_VALUES) -> CategoricalBaseline:
        """One aggregation by value, combined map-side. Booleans always have the bins false, true and other."""
        kind = df.schema[column].dataType
        counts = df.groupBy(quoted(column).alias("value")).agg(F.count("*").cast("double").alias("bl")).persist()  # read twice
        sizes = counts.agg(F.sum("bl"), F.sum(F.when(F.col("value").isNull(), F.col("bl"))), F.count("value")).first()
        rows, nulls, distinct = sizes[0] or 0.0, sizes[1] or 0.0, sizes[2]
        if not rows or not distinct and not isinstance(kind, T.BooleanType):
            counts.unpersist()
            raise EmptyBaselineData(f"{column}: a categorical baseline needs at least one value")
        present = counts.where(F.col("value").isNotNull())
        if distinct > local_values:
            return cls(None, None, rows, nulls, nullable, kind, present)
        found = {r["value"]: r["bl"] for r in present.collect()}
        counts.unpersist()
        if isinstance(kind, T.BooleanType):
            found = {v: found.get(v, 0.0) for v in (False, True)}
        values = sorted(found, key=lambda v: v.encode() if isinstance(v, str) else v)
        return cls(values, [*(found[v] for v in values), 0.0], rows, nulls, nullable, kind)

    @property
    def n_bins(self) -> int:
        return len(self.baseline_hist) if self.counts is None else self.counts.count() + 1

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """(value, bl), without the other bin."""
        if self.counts is not None:
            return self.counts
        schema = T.StructType([T.StructField("value", self.value_type), T.StructField("bl", T.DoubleType())])
        known = spark.createDataFrame(list(zip(self.values, self.baseline_hist, strict=False)), schema)
        return F.broadcast(known)  # LOCAL_VALUES rows at most

    def candidate_histogram(self, df: DataFrame, column: str) -> DataFrame:
        """(key, rt) per value of the candidate: the value as text behind a v, or n for null. Combined map-side, before any join.

        The key is never null, so no filter on nulls is pushed below the aggregation and all readers share one scan."""
        return df.groupBy(text_key(quoted(column)).alias("key")).agg(F.count("*").cast("double").alias("rt"))

    @staticmethod
    def is_null_key(candidate: DataFrame) -> Column:
        return candidate["key"] == NULL_KEY

    def paired(self, candidate: DataFrame, spark: SparkSession) -> DataFrame:
        """(value, bl, rt) for all known values and one row (null, 0, unknown values) for the other bin."""
        known = self.vocabulary(spark)
        named = known.select(F.col("value").alias("known_value"), text_key(F.col("value")).alias("known_key"))
        named = F.broadcast(named) if self.counts is None else named  # LOCAL_VALUES rows at most
        matched = candidate.join(named, F.col("key") == F.col("known_key"), "left")
        folded = matched.groupBy(F.col("known_value").alias("value")).agg(F.sum(F.when(F.col("key") == NULL_KEY, 0.0).otherwise(F.col("rt"))).alias("rt"))
        bins = known.unionByName(spark.createDataFrame([(None, 0.0)], T.StructType([T.StructField("value", self.value_type), T.StructField("bl", T.DoubleType())])))
        return bins.join(folded.withColumnRenamed("value", "rt_value"), F.col("value").eqNullSafe(F.col("rt_value")), "left").select("value", "bl", F.coalesce("rt", F.lit(0.0)).alias("rt"))

    def profile(self, spark: SparkSession) -> DataFrame:
        """(value, n)."""
        return self.vocabulary(spark).select("value", F.col("bl").alias("n"))


Baseline = ContinuousBaseline | CategoricalBaseline


def fit_column(df: DataFrame, column: str, quantile_type: QuantileType = QuantileType.FREEDMAN_DIACONIS, nullable: bool = True) -> Baseline:
    """The baseline that the column's type asks for."""
    if class_of(df.schema[column].dataType) is ColumnClass.CONTINUOUS:
        return ContinuousBaseline.fit(df, column, quantile_type, nullable)
    return CategoricalBaseline.fit(df, column, nullable)


def merge_histograms(histograms: list[DataFrame], keys: list[str], count: str = "rt") -> DataFrame:
    """The sum of histograms with the same columns."""
    return reduce(DataFrame.unionByName, histograms).groupBy(*keys).agg(F.sum(count).alias(count))
