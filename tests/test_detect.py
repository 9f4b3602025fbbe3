import math

import pytest
from pyspark.sql import functions as F

from tidemark.enums import CategoricalMetric as K
from tidemark.enums import ContinuousMetric as C
from tidemark.enums import QuantileType as Q
from tidemark.errors import EmptyBaselineData, EmptyRuntimeData, NaNValueError, SchemaError, UnsupportedTypeError
from tidemark.operators import detect as D
from tidemark.operators.baseline import CategoricalBaseline, ContinuousBaseline, fit_column
from tidemark.operators.table import BaselineTable


def numbers(spark, values, kind="double"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"v {kind}")


def labels(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_continuous(spark):
    base = numbers(spark, [1, 2, 3, 4, 5])
    assert D.compute_drift_continuous_distribution(base, base, "v", [C.POPULATION_STABILITY_INDEX])[0] == pytest.approx(0, abs=1e-9)
    assert D.compute_drift_continuous_distribution(base, numbers(spark, range(20, 25)), "v", [C.POPULATION_STABILITY_INDEX], Q.SCOTT)[0] > 0.5
    detector = D.ContinuousDrift.fit(numbers(spark, range(100)), "v")
    assert detector.n_bins == 5 and detector.baseline.baseline_hist == [0, 20, 20, 20, 40]
    asked = [C.HELLINGER, C.JENSEN_SHANNON, C.HELLINGER]
    first = detector.compute_drift_multiple_criteria(numbers(spark, range(20, 80)), "v", asked)
    assert [m for m, _ in first] == asked and first[0] == first[2]
    assert detector.compute_drift_multiple_criteria(numbers(spark, range(20, 80)), "v", asked) == first  # stateless
    detector.reset_baseline(numbers(spark, range(50)), "v")
    assert detector.n_bins == 4
    with pytest.raises(EmptyRuntimeData):
        detector.compute_drift(numbers(spark, []), "v", C.HELLINGER)
    for bad, error in (([], EmptyBaselineData), ([1], EmptyBaselineData), ([1, math.nan, 3], NaNValueError)):
        with pytest.raises(error):
            D.ContinuousDrift.fit(numbers(spark, bad), "v")


def test_nulls(spark):
    detector = D.ContinuousDrift.fit(numbers(spark, [*range(100), None, None]), "v")
    assert detector.baseline.sample_size == 102 and detector.baseline.null_count == 2
    found, nulls = detector.compute_with_nulls(numbers(spark, [*range(100), *[None] * 25]), "v", [C.KOLMOGOROV_SMIRNOV])
    assert found[0][1] == pytest.approx(0, abs=1e-9) and nulls == pytest.approx(0.2)
    odd = numbers(spark, [math.nan, 1.0, 2.0, 50.0])
    assert D.ContinuousDrift(detector.baseline, nan_as_null=True).compute_with_nulls(odd, "v", [C.HELLINGER])[1] == 0.25
    assert detector.compute_with_nulls(odd, "v", [C.HELLINGER])[1] == 0
    found, nulls = D.compute_drift_nullable_categorical_distribution(labels(spark, ["a", "b", None]), labels(spark, ["a", "b", None, None]), "v", [K.CHI_SQUARED])
    assert found[0] == pytest.approx(0, abs=1e-9) and nulls == 0.5


def test_categorical(spark):
    base = labels(spark, list("abacba"))
    assert D.compute_drift_categorical_distribution(base, base, "v", list(K)) == pytest.approx([0] * 7, abs=1e-9)
    assert D.compute_drift_categorical_distribution(labels(spark, list("aaaab")), labels(spark, list("bbbba")), "v", [K.POPULATION_STABILITY_INDEX])[0] > 0.25
    detector = D.CategoricalDrift.fit(labels(spark, list("abac")), "v")
    assert detector.n_bins == 4
    novel = detector.compute_drift_multiple_criteria(labels(spark, list("xxxx")), "v", list(K))
    assert all(math.isfinite(v) and v > 0 for _, v in novel) and dict(novel)[K.WASSERSTEIN_DISTANCE] == pytest.approx(1)
    with pytest.raises(EmptyBaselineData):
        D.CategoricalDrift.fit(labels(spark, []), "v")
    with pytest.raises(EmptyRuntimeData):
        detector.compute_drift(labels(spark, []), "v", K.G_TEST)
    assert D.compute_drift_categorical_distribution(labels(spark, [1, 2, 1, 3, 2, 1], "int"), labels(spark, [1, 2, 1, 3, 2, 1], "int"), "v", [K.G_TEST])[0] == pytest.approx(0, abs=1e-9)


def test_vocabulary_order_case_and_booleans(spark):
    words = CategoricalBaseline.fit(labels(spark, ["Two", "One", "Three", "Four", "é", "b"]), "v")
    assert words.values == ["Four", "One", "Three", "Two", "b", "é"]
    pairs = {r["value"]: r["rt"] for r in words.paired(words.candidate_histogram(labels(spark, ["four", "FOUR", "Four"]), "v"), spark).collect()}
    assert pairs[None] == 2 and pairs["Four"] == 1
    flags = CategoricalBaseline.fit(labels(spark, [True, True, None], "boolean"), "v")
    assert flags.values == [False, True] and flags.baseline_hist == [0, 2, 0] and flags.null_count == 1


def test_large_vocabulary_stays_a_table(spark):
    base = spark.range(50).select((F.col("id") % 25).alias("v"))
    small, large = CategoricalBaseline.fit(base, "v"), CategoricalBaseline.fit(base, "v", local_values=10)
    assert large.counts is not None and large.n_bins == small.n_bins == 26
    candidate = spark.range(60).select((F.col("id") % 30).alias("v"))
    a, b = (dict(D.CategoricalDrift(x).compute_drift_multiple_criteria(candidate, "v", list(K))) for x in (small, large))
    assert a == pytest.approx(b)


def test_bin_dataset(spark):
    rows = D.bin_dataset(numbers(spark, [0.1, 0.3, 0.55, 1.0, -1.0, 0.25]), "v", [0.25, 0.5, 0.75]).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [2, 2, 1, 1]
    assert [r["n"] for r in D.approximate_dataset(numbers(spark, reversed(range(100))), "v").orderBy("bin").collect()] == [0, 20, 20, 20, 40]


def test_single_precision(spark):
    b = ContinuousBaseline.fit(numbers(spark, [x / 100 for x in range(101)], "float"), "v")
    assert all(float(e) == e for e in b.bin_edges) and sum(b.baseline_hist) == 101


def test_types(spark):
    assert isinstance(fit_column(numbers(spark, range(9)), "v"), ContinuousBaseline)
    assert isinstance(fit_column(labels(spark, [1, 2], "long"), "v"), CategoricalBaseline)
    with pytest.raises(UnsupportedTypeError):
        fit_column(spark.sql("SELECT DATE '2024-01-01' AS v"), "v")


def people(spark, rows):
    return spark.createDataFrame(rows, "age double, `home town` string, member boolean, kids int")


BASE = [(float(20 + i), "Rome" if i % 3 else "Oslo", i % 2 == 0, i % 4) for i in range(40)]


def test_table(spark):
    table = BaselineTable.fit(people(spark, BASE))
    same = {(r["column"], r["metric"]): r for r in table.drift(people(spark, BASE)).collect()}
    assert len(same) == 6 + 3 * 7 and all(abs(r["drift_magnitude"]) < 1e-9 for r in same.values())
    moved = people(spark, [(90.0, "Bern", None, 9)] * 10)
    rows = {(r["column"], r["metric"]): r for r in table.drift(moved).collect()}
    assert rows["home town", "WassersteinDistance"]["drift_magnitude"] == pytest.approx(1, abs=1e-6)
    assert rows["member", "Hellinger"]["null_percentage"] == 1 and rows["age", "Hellinger"]["null_percentage"] == 0
    parts = table.empty_candidate(spark)
    with pytest.raises(EmptyRuntimeData):
        table.compute_candidate_drift(parts)
    for k in range(4):
        parts.insert(people(spark, BASE[k * 10 : k * 10 + 10]))
    merged = table.compute_candidate_drift(parts).collect()
    assert all(abs(r["drift_magnitude"]) < 1e-9 for r in merged)
    assert {r["key"]: r["rt"] for r in parts.get_column("kids").collect()} == {"0": 10, "1": 10, "2": 10, "3": 10}
    assert parts.get_column("none") is None


def test_table_schema(spark):
    table = BaselineTable.fit(people(spark, BASE))
    other = people(spark, BASE).drop("kids").withColumn("age", F.col("age").cast("float")).withColumn("new", F.lit(1))
    report = table.validate(other)
    assert report.invalid_type_columns == [("age", "double", "float")] and report.missing_baseline_columns == ["kids"] and report.extra_candidate_columns == ["new"]
    with pytest.raises(SchemaError):
        table.bin(other)
    assert table.validate(people(spark, BASE).select("kids", "member", "age", "`home town`")).valid


@pytest.mark.parametrize("kind", ["continuous", "categorical"])
def test_the_candidate_is_scanned_once(spark, tmp_path, kind):
    """Sizes and bins come from one aggregation: the executed plan has one scan, and reads its exchange again."""
    path = str(tmp_path / "candidate")
    spark.range(2000).selectExpr("if(id % 9 = 0, null, cast(id AS double)) AS x", "if(id % 7 = 0, null, cast(id % 5 AS string)) AS w").write.parquet(path)
    column = "x" if kind == "continuous" else "w"
    candidate = spark.read.parquet(path)
    model = D.ContinuousDrift if kind == "continuous" else D.CategoricalDrift
    rows = model.fit(spark.read.parquet(path), column).drift(candidate, column)
    assert rows.count() == len(rows.collect()) > 5
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("== Final Plan ==") : plan.index("== Initial Plan ==")]
    assert final.count("FileScan parquet") == 1, final
