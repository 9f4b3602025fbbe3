"""JSON forms of baselines and streams, and how they are read back."""

from __future__ import annotations

import json
import time
from decimal import Decimal
from typing import TYPE_CHECKING

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..enums import QuantileType
from ..errors import DeserializationError, InvalidDriftMode, UnsupportedOperation
from ..operators.baseline import Baseline, CategoricalBaseline, ContinuousBaseline
from ..streaming.mode import StreamMode, mode_from_export

if TYPE_CHECKING:
    from ..streaming.window import StreamingDrift


def baseline_data(b: Baseline) -> dict:
    if isinstance(b, ContinuousBaseline):
        data = {"bin_edges": b.bin_edges, "baseline_hist": b.baseline_hist, "quantile_type": b.quantile_type.value, "sample_size": b.sample_size if b.nullable else b.sample_size - b.null_count}
        return data | ({"null_count": b.null_count} if b.nullable else {})
    if b.counts is not None:
        raise UnsupportedOperation("a vocabulary of this size is a table: write CategoricalBaseline.counts instead")
    data = {"baseline_hist": b.baseline_hist, "baseline_values": [int(v) if isinstance(v, Decimal) else v for v in b.values]}
    return data | ({"total_samples": b.sample_size, "null_samples": b.null_count} if b.nullable else {"sample_size": b.sample_size})


def baseline_from(data: dict, value_type: T.DataType | None = None) -> Baseline:
    try:
        if "bin_edges" in data:
            nullable = "null_count" in data
            return ContinuousBaseline([float(x) for x in data["bin_edges"]], [float(x) for x in data["baseline_hist"]], float(data["sample_size"]), QuantileType.parse(data["quantile_type"]), float(data.get("null_count", 0)), nullable)
        nullable = "total_samples" in data
        size = data["total_samples"] if nullable else data["sample_size"]
        values = list(data["baseline_values"])
        value_type = value_type or _type_of(values)
        values = [Decimal(v) for v in values] if isinstance(value_type, T.DecimalType) else values
        return CategoricalBaseline(values, [float(x) for x in data["baseline_hist"]], float(size), float(data.get("null_samples", 0)), nullable, value_type)
    except (KeyError, TypeError, ValueError) as e:
        raise DeserializationError(f"no baseline: {e!r}") from e


def _type_of(values: list) -> T.DataType:
    if values and isinstance(values[0], bool):
        return T.BooleanType()
    if values and isinstance(values[0], int):  # the upper half of unsigned 64-bit integers is beyond a long
        return T.LongType() if max(values) < 1 << 63 else T.DecimalType(20, 0)
    return T.StringType()


def export_baseline(b: Baseline) -> str:
    return json.dumps(baseline_data(b))


def _parsed(text: str | bytes) -> dict:
    try:
        data = json.loads(text)
    except ValueError as e:
        raise DeserializationError(str(e)) from e
    if not isinstance(data, dict):
        raise DeserializationError("an export is a JSON object")
    return data


def restore_baseline(text: str | bytes, value_type: T.DataType | None = None) -> Baseline:
    return baseline_from(_parsed(text), value_type)


def read_export(spark: SparkSession, path: str) -> str:
    """The text of an export in any store that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]


def export_stream(detector: StreamingDrift, stateful: bool = False) -> str:
    """Baseline and mode, and with `stateful` the counts and totals."""
    b, s = detector.baseline, detector.state
    data: dict = {"baseline": baseline_data(b), "stream_mode": detector.mode.to_export()}
    if stateful:
        data["stream_bins"] = s.bins
        data |= {"total_samples": s.total, "null_samples": s.nulls} if b.nullable else {"total_stream_size": s.total}
        data["last_flush"] = s.last_flush
    return json.dumps(data)


def restore_stream(text: str | bytes, value_type: T.DataType | None = None, mode: type[StreamMode] | None = None) -> StreamingDrift:
    """mode: the mode that the export must have. Without totals, the sum of the counts stands for them."""
    from ..streaming.window import StreamingDrift, StreamState

    data = _parsed(text)
    if "baseline" not in data or "stream_mode" not in data:
        raise DeserializationError("a stream export has a baseline and a stream_mode")
    found = mode_from_export(data["stream_mode"])
    if mode is not None and not isinstance(found, mode):
        raise InvalidDriftMode(f"the export is of mode {type(found).__name__}")
    state = None
    if "stream_bins" in data:
        bins = [float(x) for x in data["stream_bins"]]
        nulls = float(data.get("null_samples", 0))
        total = float(data.get("total_samples", data.get("total_stream_size", sum(bins) + nulls)))
        state = StreamState(bins, total, nulls, float(data.get("last_flush", time.time())))
    return StreamingDrift(baseline_from(data["baseline"], value_type), found, state)
