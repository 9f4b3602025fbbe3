"""Drift of whole tables: all columns of a side in one pass."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..enums import ColumnClass, QuantileType, metrics_of
from ..errors import EmptyBaselineData, EmptyRuntimeData
from ..functions.metrics import drift_rows
from ..sources.schema import SchemaReport, class_of, compare_schema, require_schema
from .baseline import LOCAL_VALUES, Baseline, CategoricalBaseline, ContinuousBaseline, quoted

HIST = "column string, key string, rt double"


class BaselineTable:
    """A baseline per column. Sizes include nulls, as table drift counts them."""

    def __init__(self, columns: dict[str, Baseline], types: dict[str, T.DataType]) -> None:
        self.columns, self.types = columns, types

    @classmethod
    def fit(cls, df: DataFrame, quantile_types: dict[str, QuantileType] | None = None) -> BaselineTable:
        """Continuous columns share a few passes (range, quartiles, counts per bin), categorical ones another."""
        rules = quantile_types or {}
        types = {f.name: f.dataType for f in df.schema.fields}
        classes = {c: class_of(t) for c, t in types.items()}
        columns: dict[str, Baseline] = {}
        continuous = {c: rules.get(c, QuantileType.FREEDMAN_DIACONIS) for c, k in classes.items() if k is ColumnClass.CONTINUOUS}
        if continuous:
            columns |= ContinuousBaseline.fit_all(df, continuous)
        columns |= _fit_categorical(df, [c for c, k in classes.items() if k is ColumnClass.CATEGORICAL], types)
        return cls({c: columns[c] for c in types}, types)

    @property
    def schema(self) -> dict[str, str]:
        return {c: t.simpleString() for c, t in self.types.items()}

    def validate(self, candidate: DataFrame) -> SchemaReport:
        return compare_schema(self.schema, candidate.schema)

    def bin(self, df: DataFrame) -> CandidateTable:
        """The candidate's histograms: one pass over all columns."""
        return CandidateTable(self, df.sparkSession).insert(df)

    def empty_candidate(self, spark: SparkSession) -> CandidateTable:
        return CandidateTable(self, spark)

    def drift(self, df: DataFrame) -> DataFrame:
        """(column, column_class, metric, drift_magnitude, null_percentage), all metrics of each column's class. Counts the candidate; an empty one is an error."""
        return self.compute_candidate_drift(self.bin(df))

    def compute_candidate_drift(self, candidate: CandidateTable) -> DataFrame:
        if candidate.histogram.isEmpty():
            raise EmptyRuntimeData("the candidate table has no rows")
        return candidate.drift()

    def _grid(self, spark: SparkSession) -> DataFrame:
        """(column, key, bin, bl, bl_n): each bin of each column; the other bin of categorical columns has a null key."""
        local, large = [], []
        for c, b in self.columns.items():
            if isinstance(b, ContinuousBaseline):
                local += [(c, str(k), k, n, b.sample_size) for k, n in enumerate(b.baseline_hist)]
            elif b.counts is None:
                local += [(c, _as_key(v), k, n, b.sample_size) for k, (v, n) in enumerate(zip(b.values, b.baseline_hist, strict=False))] + [(c, None, len(b.values), 0.0, b.sample_size)]
            else:
                local.append((c, None, -1, 0.0, b.sample_size))
                large.append(b.counts.select(F.lit(c).alias("column"), F.col("value").cast("string").alias("key"), F.lit(0).alias("bin"), "bl", F.lit(b.sample_size).alias("bl_n")))
        return reduce(DataFrame.unionByName, [spark.createDataFrame(local, "column string, key string, bin int, bl double, bl_n double"), *large])


def _as_key(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _fit_categorical(df: DataFrame, names: list[str], types: dict[str, T.DataType]) -> dict[str, Baseline]:
    if not names:
        return {}
    counts = _long(df, {c: quoted(c).cast("string") for c in names}).groupBy("column", "key").agg(F.count("*").cast("double").alias("bl")).persist()  # read twice
    sizes = {r["column"]: r for r in counts.groupBy("column").agg(F.sum("bl").alias("rows"), F.sum(F.when(F.col("key").isNull(), F.col("bl"))).alias("nulls"), F.count("key").alias("distinct")).collect()}
    small = [c for c in names if c in sizes and sizes[c]["distinct"] <= LOCAL_VALUES]
    found: dict[str, dict] = {c: {} for c in names}
    for r in counts.where(F.col("column").isin(small) & F.col("key").isNotNull()).collect():  # LOCAL_VALUES rows a column at most
        found[r["column"]][r["key"]] = r["bl"]
    counts.unpersist()
    out: dict[str, Baseline] = {}
    for c in names:
        if c not in sizes or not sizes[c]["distinct"] and not isinstance(types[c], T.BooleanType):
            raise EmptyBaselineData(f"{c}: a categorical baseline needs at least one value")
        rows, nulls = sizes[c]["rows"], sizes[c]["nulls"] or 0.0
        if c not in small:
            present = df.where(quoted(c).isNotNull()).groupBy(quoted(c).alias("value")).agg(F.count("*").cast("double").alias("bl"))
            out[c] = CategoricalBaseline(None, None, rows, nulls, True, types[c], present)
            continue
        value_of = {"boolean": lambda k: k == "true", "string": str, "decimal(20,0)": Decimal}.get(types[c].simpleString(), int)
        if isinstance(types[c], T.BooleanType):
            found[c] = {k: found[c].get(k, 0.0) for k in ("false", "true")}
        by_value = {value_of(k): n for k, n in found[c].items()}
        values = sorted(by_value, key=lambda v: v.encode() if isinstance(v, str) else v)
        out[c] = CategoricalBaseline(values, [*(by_value[v] for v in values), 0.0], rows, nulls, True, types[c])
    return out


def _long(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(column, key): the keys of all columns, a row each; aggregated right where they are made."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), k.alias("key")) for c, k in keys.items()])
    return df.select(F.explode(pairs).alias("x")).select("x.column", "x.key")


class CandidateTable:
    """Histograms of a candidate, binned with the baseline's bins; further batches add up."""

    def __init__(self, baseline: BaselineTable, spark: SparkSession) -> None:
        self.baseline, self.spark = baseline, spark
        self.histogram = spark.createDataFrame([], HIST)
        self.inserted = 0

    def insert(self, df: DataFrame) -> CandidateTable:
        """Adds a batch; its schema must be the baseline's."""
        require_schema(self.baseline.schema, df.schema)
        keys = {c: (b.key(quoted(c)) if isinstance(b, ContinuousBaseline) else quoted(c)).cast("string") for c, b in self.baseline.columns.items()}
        batch = _long(df, keys).groupBy("column", "key").agg(F.count("*").cast("double").alias("rt"))
        batch = batch if not self.inserted else self.histogram.unionByName(batch).groupBy("column", "key").agg(F.sum("rt").alias("rt"))
        former, self.histogram = self.histogram, batch.persist()  # read several times by drift(); a row per column and bin or value
        if self.inserted:
            self.histogram.count()  # from now on nothing reads the former one
            former.unpersist()
        self.inserted += 1
        return self

    def release(self) -> None:
        """Frees the kept histogram; it is counted again if it is read again."""
        self.histogram.unpersist()

    def get_column(self, name: str) -> DataFrame | None:
        """(key, rt) of a column, or None if the baseline has no such column."""
        return self.histogram.where(F.col("column") == name).select("key", "rt") if name in self.baseline.columns else None

    def null_percentages(self) -> DataFrame:
        """(column, null_percentage)."""
        nulls = F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("rt"))), F.lit(0.0))
        return self.histogram.groupBy("column").agg((nulls / F.sum("rt")).alias("null_percentage"))

    def drift(self) -> DataFrame:
        grid = self.baseline._grid(self.spark)
        sizes = self.histogram.groupBy("column").agg(F.sum("rt").alias("rt_n"), F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("rt"))), F.lit(0.0)).alias("nulls"))
        present = self.histogram.where(F.col("key").isNotNull())
        known = grid.where(F.col("key").isNotNull()).select(F.col("column").alias("c"), F.col("key").alias("known_key"))
        matched = present.join(known, (F.col("column") == F.col("c")) & (F.col("key") == F.col("known_key")), "left")
        folded = matched.groupBy(F.col("column").alias("c"), F.col("known_key").alias("k")).agg(F.sum("rt").alias("rt"))  # unknown values meet in the null key
        pairs = grid.join(folded, (F.col("column") == F.col("c")) & F.col("key").eqNullSafe(F.col("k")), "left").drop("c", "k").fillna(0.0, ["rt"])
        pairs = pairs.join(F.broadcast(sizes), "column")  # a row per column
        pairs = pairs.withColumn("null_percentage", F.col("nulls") / F.col("rt_n"))
        out = []
        for kind in ColumnClass:
            names = [c for c, b in self.baseline.columns.items() if b.column_class is kind]
            if names:
                rows = drift_rows(pairs.where(F.col("column").isin(names)), kind, list(metrics_of(kind)), ["column", "null_percentage"])
                out.append(rows.select("column", F.lit(kind.value).alias("column_class"), "metric", "drift_magnitude", "null_percentage"))
        return reduce(DataFrame.unionByName, out)
