"""The drift queries that __spark_entry__.py registers, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..enums import CategoricalMetric, ContinuousMetric, Named, QuantileType
from ..errors import DriftError
from ..functions.binning import bin_count, bin_edges, bin_of, summarise
from ..operators.baseline import CategoricalBaseline, ContinuousBaseline
from ..operators.contract import ContractBuilder, NullableCategoricalContract, NullableContinuousContract, column_states, evaluate_table
from ..operators.detect import (
    CategoricalDrift,
    ContinuousDrift,
    approximate_dataset,
    bin_dataset,
    compute_drift_categorical_distribution,
    compute_drift_categorical_distribution_par,
    compute_drift_continuous_distribution,
    compute_drift_nullable_categorical_distribution_par,
)
from ..operators.table import BaselineTable
from ..sources.export import export_baseline, export_stream, read_export, restore_baseline, restore_stream
from ..streaming.mode import ExponentialDecay, Flush
from ..streaming.window import StreamingDrift

Query = Callable[[SparkSession, str], DataFrame]

#: Metrics that grow with the number of rows are rounded to 6 places, others to 9.
GROWING = ("ChiSquared", "GTest")
TABLE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "l_returnflag", "l_linestatus"]
NULLED = "CASE WHEN l_linenumber = 7 THEN NULL ELSE {} END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split(df: DataFrame, column: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Rows before and from a time on. Both filters reach the scan."""
    moment = F.expr(f"TIMESTAMP_NTZ '{at}'")
    return df.where(F.col(column) < moment), df.where(F.col(column) >= moment)


def rounded(rows: DataFrame) -> DataFrame:
    value = F.when(F.col("metric").isin(*GROWING), F.round("drift_magnitude", 6)).otherwise(F.round("drift_magnitude", 9)) + 0.0
    return rows.withColumn("drift_magnitude", value)


def result(rows: DataFrame) -> DataFrame:
    return rounded(rows).select("metric", "drift_magnitude", F.round("null_percentage", 9).alias("null_percentage"))


def lineitem_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return split(table(spark, sf_dir, "lineitem"), "l_shipdate", "1998-07-01 00:00:00")


def order_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The baseline has no urgent orders, so the other bin fills."""
    before, after = split(table(spark, sf_dir, "orders"), "o_orderdate", "1998-07-01 00:00:00")
    return before.where("o_orderpriority <> '1-URGENT'"), after


def continuous(column: str, rule: QuantileType = QuantileType.FREEDMAN_DIACONIS, metrics: list[Named] | None = None, expression: str | None = None, candidate: str = "true", baseline: str = "true") -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        before, after = lineitem_sides(spark, sf_dir)
        value = F.expr(expression or column).alias("v")
        bl, rt = before.where(baseline).select(value), after.where(candidate).select(value)
        return result(ContinuousDrift.fit(bl, "v", rule).drift(rt, "v", metrics))

    return query


def categorical(metrics: list[Named] | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bl, rt = order_sides(spark, sf_dir)
        return result(CategoricalDrift.fit(bl, "o_orderpriority").drift(rt, "o_orderpriority", metrics))

    return query


def lineitem_categorical(expression: str, baseline: str = "true") -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        before, after = lineitem_sides(spark, sf_dir)
        value = F.expr(expression).alias("v")
        return result(CategoricalDrift.fit(before.where(baseline).select(value), "v").drift(after.select(value), "v"))

    return query


def other_table(name: str, column: str, when: str, at: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        before, after = split(table(spark, sf_dir, name), when, at)
        return result(ContinuousDrift.fit(before, column).drift(after, column))

    return query


def table_sides(spark: SparkSession, sf_dir: str, nulled: bool) -> tuple[DataFrame, DataFrame]:
    """The candidate has only the larger quantities, so it drifts."""
    names = [F.expr(NULLED.format(c)).alias(c) if nulled and c in ("l_discount", "l_returnflag") else F.col(c) for c in TABLE_COLUMNS]
    before, after = lineitem_sides(spark, sf_dir)
    return before.select(*names), after.where("l_quantity > 20").select(*names)


def table_drift_of(nulled: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bl, rt = table_sides(spark, sf_dir, nulled)
        return rounded(BaselineTable.fit(bl).drift(rt)).withColumn("null_percentage", F.round("null_percentage", 9))

    return query


def table_null_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    bl, rt = table_sides(spark, sf_dir, True)
    return BaselineTable.fit(bl).bin(rt).null_percentages().withColumn("null_percentage", F.round("null_percentage", 9))


def merge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three slices inserted one after the other give what one insert gives."""
    bl, rt = table_sides(spark, sf_dir, False)
    candidate = BaselineTable.fit(bl).empty_candidate(spark)
    for k in range(3):
        candidate.insert(rt.where(F.col("l_linenumber") % 3 == k))
    return rounded(candidate.drift()).withColumn("null_percentage", F.round("null_percentage", 9))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    bl, rt = table_sides(spark, sf_dir, True)
    drift = rounded(BaselineTable.fit(bl).drift(rt))
    return evaluate_table(drift, NullableContinuousContract(hellinger=0.2), NullableCategoricalContract(chi_squared=50.0))


def contract_check(column_class: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = evaluated(spark, sf_dir).where(F.col("column_class") == column_class)
        return rows.select("column", "metric", "threshold", F.round("delta", 6).alias("delta"), "result")

    return query


def contract_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_states(evaluated(spark, sf_dir))


def approx_dataset(rule: QuantileType) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return approximate_dataset(table(spark, sf_dir, "lineitem"), "l_extendedprice", rule)

    return query


def approx_with_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_dataset(table(spark, sf_dir, "lineitem"), "l_quantity", [5.0, 10.0, 25.0, 40.0])


def profile_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = ContinuousBaseline.fit(table(spark, sf_dir, "orders"), "o_totalprice").profile(spark)
    return profile.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


def profile_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CategoricalBaseline.fit(table(spark, sf_dir, "orders"), "o_orderpriority").profile(spark)


def profile_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and null counts of both kinds of profile."""
    df = table(spark, sf_dir, "lineitem")
    a = ContinuousBaseline.fit(df.select(F.expr(NULLED.format("l_discount")).alias("v")), "v")
    b = CategoricalBaseline.fit(df.select(F.expr(NULLED.format("l_returnflag")).alias("v")), "v")
    rows = [("l_discount", a.n_bins, a.sample_size, a.null_count), ("l_returnflag", b.n_bins, b.sample_size, b.null_count)]
    return spark.createDataFrame(rows, "column string, n_bins long, size double, null_count double")


COUNTED = [("lineitem", "l_extendedprice"), ("lineitem", "l_discount"), ("orders", "o_totalprice"), ("events", "value"), ("supplier", "s_acctbal")]


def bin_counts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, column in COUNTED:
        df = table(spark, sf_dir, name)
        for rule in QuantileType:
            rows.append((column, rule.value, bin_count(summarise(df, column, rule, False), rule)))
    return spark.createDataFrame(rows, "column string, rule string, n_bins long")


def _event_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return events.where("event_id % 10 < 2"), events.where("event_id % 10 >= 2").withColumn("batch", (F.col("event_id") % 8).cast("int"))


def _stream_rows(spark: SparkSession, found: list) -> DataFrame:
    rows = [(batch, total, m.value, v) for batch, total, metrics in found for m, v in metrics]
    made = rounded(spark.createDataFrame(rows, "batch int, total double, metric string, drift_magnitude double"))
    return made.withColumn("total", F.round("total", 6))


def stream_flush_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight batches; the window holds three eighths of the events, less what a batch must leave free."""
    bl, rt = _event_sides(spark, sf_dir)
    baseline = ContinuousBaseline.fit(bl, "value")
    size = int(rt.count() * 3 / 8)
    return _stream_rows(spark, StreamingDrift(baseline, Flush(size, 10**9)).replay(rt, "value", "batch"))


def stream_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    bl, rt = _event_sides(spark, sf_dir)
    baseline = CategoricalBaseline.fit(bl.where("event_type <> 'click'"), "event_type")
    return _stream_rows(spark, StreamingDrift(baseline, ExponentialDecay.of_half_life(2.0)).replay(rt, "event_type", "batch"))


def drift_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One baseline, a candidate histogram per return flag, all in one pass."""
    from ..functions.metrics import drift_rows

    before, after = lineitem_sides(spark, sf_dir)
    b = ContinuousBaseline.fit(before, "l_quantity")
    hist = after.groupBy("l_returnflag", bin_of(F.col("l_quantity"), b.bin_edges).alias("bin")).agg(F.count("*").cast("double").alias("rt"))
    sizes = hist.groupBy("l_returnflag").agg(F.sum("rt").alias("rt_n"))
    grid = b.histogram(spark).crossJoin(sizes)  # bins times segments, both aggregated
    pairs = grid.join(hist, ["l_returnflag", "bin"], "left").fillna(0.0, ["rt"]).withColumn("bl_n", F.lit(b.sample_size))
    return rounded(drift_rows(pairs, b.column_class, list(ContinuousMetric), ["l_returnflag"])).select("l_returnflag", "metric", "drift_magnitude")


def schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bl, _ = table_sides(spark, sf_dir, False)
    changed = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_linenumber").cast("string").alias("l_linenumber"), "l_returnflag", "l_tax", "l_extendedprice", "l_discount")
    report = BaselineTable.fit(bl.select("l_quantity", "l_linenumber", "l_returnflag", "l_linestatus")).validate(changed)
    rows = [("invalid_type", *x) for x in report.invalid_type_columns] + [("missing", c, None, None) for c in report.missing_baseline_columns] + [("extra", c, None, None) for c in report.extra_candidate_columns]
    return spark.createDataFrame(rows, "kind string, column string, expected string, found string")


def edges_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin edges of a column under each rule."""
    df = table(spark, sf_dir, "customer")
    rows = []
    for rule in QuantileType:
        s = summarise(df, "c_acctbal", rule, False)
        rows += [(rule.value, k, round(e, 9)) for k, e in enumerate(bin_edges(s.low, s.high, bin_count(s, rule)))]
    return spark.createDataFrame(rows, "rule string, edge int, value double")


# ---- exports, one-call functions, further streams

STREAM_NULL = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE {} END"


def from_export(kind: str, nullable: bool) -> Query:
    """Drift against a baseline that went through its export, written to a store and read back."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        before, after = lineitem_sides(spark, sf_dir)
        column = "l_discount" if kind == "Continuous" else "l_returnflag"
        value = F.expr(NULLED.format(column) if nullable else column).alias("v")
        model = ContinuousBaseline if kind == "Continuous" else CategoricalBaseline
        fitted = model.fit(before.where("l_returnflag <> 'R'").select(value), "v", nullable=nullable)
        back = restore_baseline(stored(spark, export_baseline(fitted)))
        detector = ContinuousDrift(back) if kind == "Continuous" else CategoricalDrift(back)
        return result(detector.drift(after.select(value), "v"))

    return query


def stored(spark: SparkSession, text: str) -> str:
    """The text after a round trip through the warehouse, which the cluster shares."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark-export-{uuid.uuid4().hex}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    try:
        return read_export(spark, path)
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stream_of(spark: SparkSession, sf_dir: str, kind: str, nullable: bool) -> tuple[DataFrame, DataFrame]:
    """(baseline, batches) with a column v."""
    column = "value" if kind == "Continuous" else "event_type"
    bl, rt = _event_sides(spark, sf_dir)
    bl = bl.where("event_type <> 'click'") if kind == "Categorical" else bl
    value = F.expr(STREAM_NULL.format(column) if nullable else column).alias("v")
    return bl.select(value), rt.select(value, "batch")


def stream_mode(rt: DataFrame, mode: str) -> Flush | ExponentialDecay:
    return Flush(int(rt.count() * 3 / 8), 10**9) if mode == "flush" else ExponentialDecay.of_half_life(2.0)


def stream_query(kind: str, mode: str, nullable: bool, export: str | None = None) -> Query:
    """All batches in order. export: after half of them the stream goes through its export, "stateful" or "base" (which empties the window)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bl, rt = stream_of(spark, sf_dir, kind, nullable)
        model = ContinuousBaseline if kind == "Continuous" else CategoricalBaseline
        detector = StreamingDrift(model.fit(bl, "v", nullable=nullable), stream_mode(rt, mode))
        found = []
        for part in (rt.where("batch < 4"), rt.where("batch >= 4")) if export else (rt,):
            for batch, total, metrics in detector.replay(part, "v", "batch"):
                found.append((batch, total, metrics))
            if export:
                detector = restore_stream(export_stream(detector, export == "stateful"), mode=type(detector.mode))
        return _stream_rows(spark, found)

    return query


def stream_null_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The null share of the window after the last batch, of all kinds and modes."""
    rows = []
    for kind, model in (("Continuous", ContinuousBaseline), ("Categorical", CategoricalBaseline)):
        bl, rt = stream_of(spark, sf_dir, kind, True)
        for mode in ("flush", "decay"):
            detector = StreamingDrift(model.fit(bl, "v"), stream_mode(rt, mode))
            detector.replay(rt, "v", "batch")
            rows.append((kind, mode, round(detector.state.total, 6), round(detector.null_percentage(), 9)))
    return spark.createDataFrame(rows, "kind string, mode string, total double, null_percentage double")


def stream_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch a second; the window is emptied when it is three seconds old."""
    bl, rt = _event_sides(spark, sf_dir)
    ticks = iter([0.0, *map(float, range(8))])
    detector = StreamingDrift(ContinuousBaseline.fit(bl, "value"), Flush(10**9, 3), clock=lambda: next(ticks))
    return _stream_rows(spark, detector.replay(rt, "value", "batch"))


def stream_single_values(kind: str) -> Query:
    """The first 300 events, pushed one by one."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bl, _ = stream_of(spark, sf_dir, kind, True)
        value = F.expr(STREAM_NULL.format("value" if kind == "Continuous" else "event_type")).alias("v")
        few = table(spark, sf_dir, "events").where("event_id < 300").select(value).collect()
        detector = StreamingDrift((ContinuousBaseline if kind == "Continuous" else CategoricalBaseline).fit(bl, "v"), Flush(10**9, 10**9))
        for r in few:
            detector.update_stream(r["v"])
        return _stream_rows(spark, [(0, detector.state.total, detector.compute_drift_multiple_criteria())])

    return query


def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and the age of the window through batches, flush, reset and restore; what a decaying stream refuses."""
    now = [0.0]
    bl, rt = _event_sides(spark, sf_dir)
    baseline = ContinuousBaseline.fit(bl, "value")
    stream, rows = StreamingDrift(baseline, Flush(10**9, 10**9), clock=lambda: now[0]), []
    step = lambda name, s: rows.append((name, float(s.total_samples), s.last_flush()))
    for name, act in (("new", lambda: None), ("batch", lambda: stream.update_stream_batch(rt, "value")), ("flush", stream.flush), ("again", lambda: stream.update_stream_batch(rt, "value")), ("reset", lambda: stream.reset_baseline(baseline))):
        now[0] += 10.0
        act()
        step(name, stream)
    decaying = StreamingDrift(baseline, ExponentialDecay(0.5), clock=lambda: now[0])
    decaying.update_stream_batch(rt, "value")
    decaying.compute_drift(ContinuousMetric.HELLINGER)
    step("decay", decaying)
    rows.append(("decay cannot flush", *((1.0, 0.0) if refused(decaying.flush) == "UnsupportedOperation" else (0.0, 0.0))))
    return spark.createDataFrame(rows, "step string, total double, last_flush double")


def refused(act: Callable[[], object]) -> str | None:
    """The name of the error that it raises."""
    try:
        act()
    except DriftError as e:
        return type(e).__name__
    return None


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused, and by which error."""
    values = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("v"))
    nan = values.select(F.when(F.col("v") > 0, F.lit(float("nan"))).otherwise(F.col("v")).alias("v"))
    infinite = values.select(F.when(F.col("v") > 0, F.lit(float("inf"))).otherwise(F.col("v")).alias("v"))
    b = ContinuousBaseline.fit(values, "v")
    text, stream = export_baseline(b), export_stream(StreamingDrift(b, ExponentialDecay(0.5)))
    cut = text.replace('"bin_edges": [', '"bin_edges": [0.0, ')
    words = export_baseline(CategoricalBaseline(["a"], [1.0, 0.0], 1.0))
    cases = {
        "NaN in a baseline": lambda: ContinuousBaseline.fit(nan, "v"), "infinity in a baseline": lambda: ContinuousBaseline.fit(infinite, "v"), "empty baseline": lambda: ContinuousBaseline.fit(values.limit(0), "v"),
        "empty candidate": lambda: ContinuousDrift(b).compute_drift(values.limit(0), "v", ContinuousMetric.HELLINGER), "empty candidate table": lambda: BaselineTable.fit(values).drift(values.limit(0)),
        "an edge too many": lambda: restore_baseline(cut), "a value too many": lambda: restore_baseline(words.replace('["a"]', '["a", "b"]')), "no JSON": lambda: restore_baseline("{"), "a field missing": lambda: restore_baseline('{"bin_edges": []}'),
        "decay as flush": lambda: restore_stream(stream, mode=Flush), "metric name": lambda: ContinuousMetric.parse("hellinger"), "categorical metric name": lambda: CategoricalMetric.parse("KolmogorovSmirnov"), "rule name": lambda: QuantileType.parse("scott"),
        "good names": lambda: (ContinuousMetric.parse("Hellinger"), CategoricalMetric.parse("GTest"), QuantileType.parse("Scott")),
    }
    return spark.createDataFrame([(case, refused(act)) for case, act in cases.items()], "case string, error string")


def one_call(name: str) -> Query:
    """The one-call functions; those for parallel runs are the same."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        if name == "continuous":
            before, after = lineitem_sides(spark, sf_dir)
            metrics, nulls = list(ContinuousMetric), None
            found = compute_drift_continuous_distribution(before, after.where("l_quantity > 25"), "l_extendedprice", metrics, QuantileType.STURGES)
        else:
            before, after = order_sides(spark, sf_dir)
            metrics, nulls = list(CategoricalMetric), None
            if name == "nullable":
                value = F.expr("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END").alias("o_orderpriority")
                found, nulls = compute_drift_nullable_categorical_distribution_par(before.select(value), after.select(value), "o_orderpriority", metrics)
            else:
                run = compute_drift_categorical_distribution if name == "categorical" else compute_drift_categorical_distribution_par
                found = run(before, after, "o_orderpriority", metrics)
        rows = [(m.value, v, nulls or 0.0) for m, v in zip(metrics, found, strict=True)]
        return result(spark.createDataFrame(rows, "metric string, drift_magnitude double, null_percentage double"))

    return query


def candidate_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    bl, rt = table_sides(spark, sf_dir, True)
    return BaselineTable.fit(bl).bin(rt).get_column("l_returnflag")


def built_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states under contracts made by builders, and read back from their JSON."""
    bl, rt = table_sides(spark, sf_dir, True)
    drift = rounded(BaselineTable.fit(bl).drift(rt))
    cont = ContractBuilder(NullableContinuousContract).with_hellinger(0.2).build()
    cat = NullableCategoricalContract.from_json(ContractBuilder(NullableCategoricalContract).with_chi_squared(50.0).build().to_json())
    return column_states(evaluate_table(drift, cont, cat))


def contract_on_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract on the results of one detector, the null share beside them."""
    before, after = lineitem_sides(spark, sf_dir)
    value = F.expr(NULLED.format("l_discount")).alias("v")
    detector = ContinuousDrift.fit(before.select(value), "v")
    found, nulls = detector.compute_with_nulls(after.where("l_quantity > 25").select(value), "v", list(ContinuousMetric))
    check = ContractBuilder(NullableContinuousContract).with_kullback_leibler(1e-6).with_null_percentage(0.01).build().check([(m, round(v, 9)) for m, v in found], nulls)
    rows = [(e.metric.value, None if e.delta is None else round(e.delta, 6), e.passed, check.state.value, check.nulls_passed) for e in check.results]
    return spark.createDataFrame(rows, "metric string, delta double, passed boolean, state string, nulls_passed boolean")


def unsigned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decimal(20,0) column, as unsigned 64-bit integers arrive, through table profile, export and drift."""
    before, after = order_sides(spark, sf_dir)
    value = F.expr("cast(18446744073709551600 + o_orderkey % 7 AS decimal(20,0))").alias("v")
    bl, rt = before.select(value), after.where("o_orderkey % 7 < 5").select(value)
    back = restore_baseline(export_baseline(BaselineTable.fit(bl).columns["v"]))
    return result(CategoricalDrift(back).drift(rt, "v"))


C, K, R = ContinuousMetric, CategoricalMetric, QuantileType

QUERIES: dict[str, Query] = {
    "cont_psi": continuous("l_extendedprice", metrics=[C.POPULATION_STABILITY_INDEX]),
    "cont_kl": continuous("l_extendedprice", metrics=[C.KULLBACK_LEIBLER]),
    "cont_js": continuous("l_extendedprice", metrics=[C.JENSEN_SHANNON]),
    "cont_wasserstein": continuous("l_extendedprice", metrics=[C.WASSERSTEIN_DISTANCE]),
    "cont_ks": continuous("l_extendedprice", metrics=[C.KOLMOGOROV_SMIRNOV]),
    "cont_hellinger": continuous("l_extendedprice", metrics=[C.HELLINGER]),
    "cont_multi_fd": continuous("l_extendedprice", candidate="l_quantity > 25"),
    "cont_multi_scott": continuous("l_extendedprice", R.SCOTT, candidate="l_quantity > 25"),
    "cont_multi_sturges": continuous("l_extendedprice", R.STURGES, candidate="l_quantity > 25"),
    "cont_repeated_metrics": continuous("l_extendedprice", metrics=[C.HELLINGER, C.JENSEN_SHANNON, C.HELLINGER]),
    "cont_orders": other_table("orders", "o_totalprice", "o_orderdate", "1998-07-01 00:00:00"),
    "cont_events": other_table("events", "value", "ts", "2024-01-15 00:00:00"),
    "cont_float32": continuous("l_tax", expression="cast(l_extendedprice as float)", candidate="l_quantity > 25"),
    "cont_constant_column": continuous("l_tax", expression="cast(5 as double)"),
    "cont_zero_iqr": continuous("l_tax", expression="case when l_linenumber = 7 then l_quantity else 1.0 end", candidate="l_quantity > 25"),
    "cat_psi": categorical([K.POPULATION_STABILITY_INDEX]),
    "cat_kl": categorical([K.KULLBACK_LEIBLER]),
    "cat_js": categorical([K.JENSEN_SHANNON]),
    "cat_wasserstein": categorical([K.WASSERSTEIN_DISTANCE]),
    "cat_chi2": categorical([K.CHI_SQUARED]),
    "cat_hellinger": categorical([K.HELLINGER]),
    "cat_gtest": categorical([K.G_TEST]),
    "cat_multi": categorical(),
    "cat_int_labels": lineitem_categorical("l_linenumber"),
    "cat_bool": lineitem_categorical("l_discount > 0.05"),
    "cat_novel_labels": lineitem_categorical("l_returnflag", "l_returnflag <> 'R'"),
    "null_cont_multi": continuous("l_discount", expression=NULLED.format("l_discount"), candidate="l_quantity > 25"),
    "null_cat_multi": lineitem_categorical(NULLED.format("l_returnflag"), "l_returnflag <> 'R'"),
    "table_drift": table_drift_of(False),
    "table_drift_nulls": table_drift_of(True),
    "table_null_percentage": table_null_percentage,
    "merge_batches": merge_batches,
    "contract_check_cont": contract_check("Continuous"),
    "contract_check_cat": contract_check("Categorical"),
    "contract_state": contract_state,
    "approx_dataset_fd": approx_dataset(R.FREEDMAN_DIACONIS),
    "approx_dataset_scott": approx_dataset(R.SCOTT),
    "approx_dataset_sturges": approx_dataset(R.STURGES),
    "approx_with_edges": approx_with_edges,
    "profile_continuous": profile_continuous,
    "profile_categorical": profile_categorical,
    "profile_nullable": profile_nullable,
    "bin_counts_table": bin_counts_table,
    "edges_table": edges_table,
    "stream_flush_window": stream_flush_window,
    "stream_decay": stream_decay,
    "drift_by_segment": drift_by_segment,
    "schema_report": schema_report,
    "export_cont": from_export("Continuous", False),
    "export_null_cont": from_export("Continuous", True),
    "export_cat": from_export("Categorical", False),
    "export_null_cat": from_export("Categorical", True),
    "stream_cont_decay": stream_query("Continuous", "decay", False),
    "stream_cat_flush": stream_query("Categorical", "flush", False),
    "stream_null_cont_flush": stream_query("Continuous", "flush", True),
    "stream_null_cont_decay": stream_query("Continuous", "decay", True),
    "stream_null_cat_flush": stream_query("Categorical", "flush", True),
    "stream_null_cat_decay": stream_query("Categorical", "decay", True),
    "stream_null_percentage": stream_null_percentage,
    "stream_restore_cont": stream_query("Continuous", "decay", False, "stateful"),
    "stream_restore_cat": stream_query("Categorical", "flush", False, "stateful"),
    "stream_restore_null_cont": stream_query("Continuous", "flush", True, "stateful"),
    "stream_restore_null_cat": stream_query("Categorical", "decay", True, "stateful"),
    "stream_base_cont": stream_query("Continuous", "decay", False, "base"),
    "stream_base_cat": stream_query("Categorical", "flush", False, "base"),
    "stream_base_null_cont": stream_query("Continuous", "flush", True, "base"),
    "stream_base_null_cat": stream_query("Categorical", "decay", True, "base"),
    "stream_cadence": stream_cadence,
    "stream_single_cont": stream_single_values("Continuous"),
    "stream_single_cat": stream_single_values("Categorical"),
    "stream_lifecycle": stream_lifecycle,
    "faults": faults,
    "one_call_continuous": one_call("continuous"),
    "one_call_categorical": one_call("categorical"),
    "one_call_categorical_par": one_call("categorical_par"),
    "one_call_nullable": one_call("nullable"),
    "candidate_column": candidate_column,
    "built_contracts": built_contracts,
    "contract_on_results": contract_on_results,
    "unsigned_labels": unsigned_labels,
}
