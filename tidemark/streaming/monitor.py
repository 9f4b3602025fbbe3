"""Structured Streaming around StreamingDrift: one evaluation per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.export import export_stream, restore_stream
from .window import StreamingDrift


class StateStore:
    """Keeps the exported state of the last batch as a one-row table in a folder that the cluster shares."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def save(self, df_session, batch: int, state: str) -> None:
        df_session.createDataFrame([(batch, state)], "batch long, state string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch % 2}")

    def load(self, spark) -> tuple[int, str] | None:
        """The later of the two last states."""
        found = []
        for k in (0, 1):
            try:
                found += [tuple(r) for r in spark.read.schema("batch long, state string").parquet(f"{self.path}/batch={k}").collect()]
            except Exception as e:  # noqa: BLE001  a folder that is not there yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        return max(found, default=None)


def monitor(
    stream: DataFrame, column: str, detector: StreamingDrift, on_result: Callable[[int, list, float], None], checkpoint: str, state: StateStore | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Folds each micro-batch into the detector and passes (batch id, metrics, null share) on.

    With `state`, a restarted query goes on from the saved window; a batch that was already folded is not folded twice."""
    spark = stream.sparkSession
    if state and (saved := state.load(spark)):
        done = saved[0]
        restored = restore_stream(saved[1], detector.baseline.value_type if hasattr(detector.baseline, "value_type") else None)
        detector.state, detector.baseline = restored.state, restored.baseline
    else:
        done = -1

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= done:
            return
        counts, nulls = detector.batch_counts(batch, column)
        if sum(counts) + nulls:
            detector.fold(counts, nulls)
            if not detector.is_empty():
                on_result(batch_id, detector.compute_drift_multiple_criteria(), detector.null_percentage())
        if state:
            state.save(spark, batch_id, export_stream(detector, stateful=True))

    return stream.select(column).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
