import json
import math

import pytest

from tidemark.enums import CategoricalMetric as K
from tidemark.enums import ContinuousMetric as C
from tidemark.errors import DeserializationError, EmptyRuntimeData, InvalidDataShape, InvalidDriftMode, UnsupportedOperation
from tidemark.operators import contract as N
from tidemark.operators.baseline import CategoricalBaseline, ContinuousBaseline
from tidemark.sources import export as X
from tidemark.streaming.mode import ExponentialDecay, Flush
from tidemark.streaming.monitor import StateStore, monitor
from tidemark.streaming.window import StreamingDrift


def numbers(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")


def labels(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def test_contract_states():
    c = N.ContinuousContract()
    assert c.check([(C.HELLINGER, 0.1), (C.KOLMOGOROV_SMIRNOV, 0.05)]).state is N.DriftState.HEALTHY  # a threshold itself passes
    half = c.check([(C.HELLINGER, 0.3), (C.KOLMOGOROV_SMIRNOV, 0.05)])
    assert half.state is N.DriftState.PARTIALLY_HEALTHY and half.results[0].delta == pytest.approx(0.2) and half.results[1].passed
    assert c.check([(C.HELLINGER, 0.3)]).state is N.DriftState.UNHEALTHY
    assert c.check([]).state is N.DriftState.HEALTHY and c.check([(C.HELLINGER, math.nan)]).state is N.DriftState.HEALTHY
    nullable = N.NullableCategoricalContract(null_percentage=0.2)
    assert nullable.check([(K.G_TEST, 0.0)], 0.2).nulls_passed
    over = nullable.check([(K.G_TEST, 0.0)], 0.5)
    assert over.null_delta == pytest.approx(0.3) and over.state is N.DriftState.HEALTHY


def test_contract_builder_and_json():
    built = N.ContractBuilder(N.CategoricalContract).with_chi_squared(3).with_hellinger(0.4).build()
    assert built.chi_squared == 3 and built.hellinger == 0.4 and built.g_test == 10
    assert N.CategoricalContract.from_json(built.to_json()) == built
    with pytest.raises(AttributeError):
        N.ContractBuilder(N.CategoricalContract).with_kolmogorov_smirnov(1)


def test_contract_on_table(spark):
    rows = [("a", "Continuous", "Hellinger", 0.3, 0.0), ("a", "Continuous", "JensenShannon", 0.0, 0.0), ("b", "Categorical", "GTest", 99.0, 0.4)]
    judged = N.evaluate_table(spark.createDataFrame(rows, "column string, column_class string, metric string, drift_magnitude double, null_percentage double"))
    states = {r["column"]: (r["state"], r["null_state"]) for r in N.column_states(judged).collect()}
    assert states == {"a": ("PartiallyHealthy", "Passed"), "b": ("Unhealthy", "Failed")}


def test_export_shapes(spark):
    b = ContinuousBaseline.fit(numbers(spark, range(100)), "v")
    data = json.loads(X.export_baseline(b))
    assert data == {"bin_edges": b.bin_edges, "baseline_hist": b.baseline_hist, "quantile_type": "FreedmanDiaconis", "sample_size": 100, "null_count": 0}
    assert X.restore_baseline(json.dumps(data)) == b
    c = CategoricalBaseline.fit(labels(spark, ["a", "b", "a", None]), "v")
    data = json.loads(X.export_baseline(c))
    assert data == {"baseline_hist": [2, 1, 0], "baseline_values": ["a", "b"], "total_samples": 4, "null_samples": 1}
    assert X.restore_baseline(json.dumps(data)).baseline_hist == c.baseline_hist
    plain = CategoricalBaseline.fit(labels(spark, ["a"]), "v", nullable=False)
    assert set(json.loads(X.export_baseline(plain))) == {"baseline_hist", "baseline_values", "sample_size"}


def test_export_faults():
    good = {"bin_edges": [1.0, 2.0], "baseline_hist": [0, 1, 2], "quantile_type": "Scott", "sample_size": 3}
    for change, error in (({"bin_edges": [1.0]}, InvalidDataShape), ({"bin_edges": [1.0], "baseline_hist": [1, 2]}, InvalidDataShape)):
        with pytest.raises(error):
            X.restore_baseline(json.dumps(good | change))
    with pytest.raises(InvalidDataShape):
        X.restore_baseline('{"baseline_hist": [1, 2], "baseline_values": ["a", "b"], "sample_size": 3}')
    for text in ("{", "[]", '{"bin_edges": [1.0, 2.0]}'):
        with pytest.raises(DeserializationError):
            X.restore_baseline(text)


def test_stream_export(spark):
    s = StreamingDrift(ContinuousBaseline.fit(numbers(spark, range(100)), "v", nullable=False), ExponentialDecay(0.5))
    s.update_stream_batch(numbers(spark, range(10)), "v")
    text = X.export_stream(s, stateful=True)
    assert json.loads(text)["stream_mode"] == {"ExponentialDecay": 0.5}
    back = X.restore_stream(text)
    assert back.state.bins == s.state.bins and back.total_samples == 10
    data = json.loads(text)
    del data["total_stream_size"]
    assert X.restore_stream(json.dumps(data)).total_samples == 10  # the sum of the counts
    with pytest.raises(InvalidDriftMode):
        X.restore_stream(text, mode=Flush)
    with pytest.raises(InvalidDataShape):
        X.restore_stream(json.dumps(data | {"stream_bins": [1.0]}))
    assert X.restore_stream(X.export_stream(s)).is_empty()


def test_read_export(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"baseline_hist": [1, 0],\n "baseline_values": [7], "sample_size": 1}')
    assert X.restore_baseline(X.read_export(spark, str(tmp_path / "b.json"))).values == [7]


def test_accumulation_and_flush(spark):
    now = [100.0]
    s = StreamingDrift(ContinuousBaseline.fit(numbers(spark, [1, 2, 3, 3, 4]), "v"), Flush(1000, 50), lookahead=0, clock=lambda: now[0])
    with pytest.raises(EmptyRuntimeData):
        s.compute_drift(C.HELLINGER)
    with pytest.raises(EmptyRuntimeData):
        s.update_stream_batch(numbers(spark, []), "v")
    s.update_stream_batch(numbers(spark, [1, 2, 2, 3, 4]), "v")
    s.update_stream_batch(numbers(spark, [1, 2, 2, 3, 4, None]), "v")
    assert s.total_samples == 11 and s.null_percentage() == pytest.approx(1 / 11)
    now[0] = 120.0
    assert s.last_flush() == 20
    s.fold([0.0] * (s.n_bins - 1) + [989.0])
    assert s.total_samples == 1000
    s.fold([1.0] + [0.0] * (s.n_bins - 1))  # full: emptied before the batch
    assert s.total_samples == 1 and s.state.nulls == 0 and s.last_flush() == 0
    now[0] = 171.0
    s.fold([2.0] + [0.0] * (s.n_bins - 1))  # too old
    assert s.total_samples == 2
    s.flush()
    assert s.is_empty()
    s.fold([1.0] * s.n_bins)
    s.reset_baseline(ContinuousBaseline.fit(numbers(spark, range(100)), "v"))
    assert s.is_empty() and s.n_bins == 5


def test_decay_once_per_evaluation(spark):
    base = CategoricalBaseline.fit(labels(spark, list("abab") * 25), "v")
    one, many = (StreamingDrift(base, ExponentialDecay.of_half_life(1)) for _ in range(2))
    for s in (one, many):
        s.update_stream_batch(labels(spark, ["a"] * 60 + ["x"] * 40), "v")
    assert one.compute_drift(K.HELLINGER) == dict(many.compute_drift_multiple_criteria(list(K)))[K.HELLINGER]
    assert one.total_samples == many.total_samples == 50 and one.state.bins[-1] == 20
    with pytest.raises(UnsupportedOperation):
        one.flush()
    assert one.last_flush() == 0


def test_structured_streaming_equals_one_batch(spark, tmp_path):
    data = [float(i % 90) for i in range(400)]
    source = str(tmp_path / "in")
    for k in range(4):
        numbers(spark, data[k * 100 : k * 100 + 100]).coalesce(1).write.mode("append").parquet(source)
    base = ContinuousBaseline.fit(numbers(spark, range(100)), "v")
    stream = lambda: spark.readStream.schema("v double").option("maxFilesPerTrigger", 1).parquet(source)
    seen, store = [], StateStore(str(tmp_path / "state"))
    run = lambda: monitor(stream(), "v", StreamingDrift(base), lambda *r: seen.append(r), str(tmp_path / "checkpoint"), store).awaitTermination()
    run()
    whole = StreamingDrift(base)
    whole.update_stream_batch(numbers(spark, data), "v")
    assert [b for b, *_ in seen] == [0, 1, 2, 3] and dict(seen[-1][1]) == pytest.approx(dict(whole.compute_drift_multiple_criteria()))
    numbers(spark, [5.0] * 50).coalesce(1).write.mode("append").parquet(source)
    run()  # a restart goes on from the saved window
    whole.update_stream_batch(numbers(spark, [5.0] * 50), "v")
    assert seen[-1][0] == 4 and dict(seen[-1][1]) == pytest.approx(dict(whole.compute_drift_multiple_criteria()))
