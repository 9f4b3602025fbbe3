"""The state of a stream: counts per bin, and how batches, evaluations and flushes change it.

State is as small as the baseline's histogram, and only the histogram of a batch ever reaches the driver."""

from __future__ import annotations

import math
import time
from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..enums import Named, metrics_of
from ..errors import EmptyRuntimeData, InvalidDataShape, UnsupportedOperation
from ..functions.metrics import evaluate
from ..operators.baseline import NULL_BIN, CategoricalBaseline, ContinuousBaseline
from .mode import ExponentialDecay, Flush, StreamMode, require_flush

#: Single values: the clock is read when these bits of the window's total are zero.
CLOCK_MASK = 255
#: A batch is let in only if the window could also take this many more values.
LOOKAHEAD = 255


@dataclass
class StreamState:
    """Counts per bin, values in the window (nulls included) and nulls."""

    bins: list[float]
    total: float = 0.0
    nulls: float = 0.0
    last_flush: float = 0.0

    def flushed(self, now: float) -> StreamState:
        return StreamState([0.0] * len(self.bins), 0.0, 0.0, now)

    def decayed(self, alpha: float) -> StreamState:
        return StreamState([b * alpha for b in self.bins], self.total * alpha, self.nulls * alpha, self.last_flush)

    def added(self, counts: Sequence[float], nulls: float) -> StreamState:
        return StreamState([a + b for a, b in zip(self.bins, counts, strict=True)], self.total + sum(counts) + nulls, self.nulls + nulls, self.last_flush)

    def due(self, mode: Flush, now: float, lookahead: int) -> bool:
        return self.total > 0 and (self.total + lookahead >= mode.size or now - self.last_flush >= mode.cadence)


@dataclass
class StreamingDrift:
    """Drift of a stream's window against a baseline. One evaluation decays once, whatever the number of metrics."""

    baseline: ContinuousBaseline | CategoricalBaseline
    mode: StreamMode = field(default_factory=Flush)
    state: StreamState | None = None
    lookahead: int = LOOKAHEAD
    clock: Callable[[], float] = time.time
    _places: tuple | None = None  # of values in the vocabulary

    def __post_init__(self) -> None:
        if isinstance(self.baseline, CategoricalBaseline) and self.baseline.counts is not None:
            raise UnsupportedOperation("a stream keeps its counts on the driver; this vocabulary is too large for that")
        if self.state is None:
            self.state = StreamState([0.0] * self.baseline.n_bins, last_flush=self.clock())
        if len(self.state.bins) != self.baseline.n_bins:
            raise InvalidDataShape(f"{len(self.state.bins)} stream bins for {self.baseline.n_bins} bins")

    def batch_counts(self, df: DataFrame, column: str) -> tuple[list[float], float]:
        """(counts per bin, nulls) of a batch: one aggregation; a row per bin reaches the driver."""
        b = self.baseline
        hist = b.candidate_histogram(df, column)
        counts = [0.0] * b.n_bins
        if isinstance(b, ContinuousBaseline):
            rows = {r["bin"]: r["rt"] for r in hist.collect()}
            nulls = rows.pop(NULL_BIN, 0.0)
            for k, n in rows.items():
                counts[k] += n
            return counts, nulls
        nulls, place = 0.0, {v: k for k, v in enumerate(b.values)}
        sizes = hist.agg(F.coalesce(F.sum(F.when(b.is_null_key(hist), F.col("rt"))), F.lit(0.0)).alias("nulls"))
        for r in b.paired(hist, df.sparkSession).crossJoin(F.broadcast(sizes)).collect():  # one row, from the same exchange
            counts[len(counts) - 1 if r["value"] is None else place[r["value"]]] += r["rt"]
            nulls = r["nulls"]
        return counts, nulls

    def place_of(self, value: object) -> int | None:
        """The bin of a single value; None for null."""
        b = self.baseline
        if value is None:
            return None
        if isinstance(b, ContinuousBaseline):
            return 0 if math.isnan(value) else bisect_right(b.bin_edges, value)
        if self._places is None or self._places[0] is not b:
            self._places = b, {v: k for k, v in enumerate(b.values)}
        return self._places[1].get(value, b.n_bins - 1)

    def update_stream(self, value: object) -> None:
        """Adds a single value, in constant time but for the search of its bin. A full window is emptied before it; the clock is read every 256 values."""
        s, place = self.state, self.place_of(value)
        if isinstance(self.mode, Flush) and s.total > 0:
            full = s.total >= self.mode.size
            if full or int(s.total) & CLOCK_MASK == 0 and self.clock() - s.last_flush >= self.mode.cadence:
                s = self.state = s.flushed(self.clock())
        s.total += 1
        if place is None:
            s.nulls += 1
        else:
            s.bins[place] += 1

    def update_stream_batch(self, df: DataFrame, column: str) -> None:
        counts, nulls = self.batch_counts(df, column)
        if not sum(counts) + nulls:
            raise EmptyRuntimeData("an empty batch")
        self.fold(counts, nulls)

    def fold(self, counts: Sequence[float], nulls: float = 0.0) -> None:
        """Adds counts; a window that is due is emptied before, never within, a batch."""
        now = self.clock()
        if isinstance(self.mode, Flush) and self.state.due(self.mode, now, self.lookahead):
            self.state = self.state.flushed(now)
        self.state = self.state.added(counts, nulls)

    def compute_drift_multiple_criteria(self, metrics: Sequence[Named] | None = None) -> list[tuple[Named, float]]:
        if self.is_empty():
            raise EmptyRuntimeData("nothing in the window")
        if isinstance(self.mode, ExponentialDecay):
            self.state = self.state.decayed(self.mode.alpha)
        b, s = self.baseline, self.state
        return [(m, evaluate(b.baseline_hist, s.bins, b.sample_size - b.null_count, s.total - s.nulls, m)) for m in metrics or metrics_of(b.column_class)]

    def compute_drift(self, metric: Named) -> float:
        return self.compute_drift_multiple_criteria([metric])[0][1]

    def null_percentage(self) -> float:
        return self.state.nulls / self.state.total if self.state.total else math.nan

    def replay(self, df: DataFrame, column: str, batch: str, metrics: Sequence[Named] | None = None) -> list[tuple[object, float, list[tuple[Named, float]]]]:
        """Folds the batches of a table in order of column `batch`, evaluating after each: (batch, window total, metrics).

        The histograms of all batches come from one aggregation; a row per batch and bin reaches the driver."""
        b = self.baseline
        key = b.key(F.col(column)) if isinstance(b, ContinuousBaseline) else F.col(column)
        counts = df.groupBy(F.col(batch).alias("batch"), key.alias("key")).agg(F.count("*").cast("double").alias("n"))
        if isinstance(b, CategoricalBaseline):  # values outside the vocabulary meet before they reach the driver
            known = F.col("key").isNull() | F.col("key").isin(b.values)
            counts = counts.groupBy("batch", F.when(known, F.col("key")).alias("key"), (~known).alias("other")).agg(F.sum("n").alias("n"))
        else:
            counts = counts.withColumn("other", F.lit(False))
        place = {k: k for k in range(b.n_bins)} if isinstance(b, ContinuousBaseline) else {v: k for k, v in enumerate(b.values)}
        batches: dict = {}
        for r in counts.collect():
            bins = batches.setdefault(r["batch"], [[0.0] * b.n_bins, 0.0])
            if r["key"] is None and not r["other"]:
                bins[1] += r["n"]
            else:
                bins[0][b.n_bins - 1 if r["other"] else place[r["key"]]] += r["n"]
        out = []
        for name in sorted(batches):
            self.fold(*batches[name])
            found = self.compute_drift_multiple_criteria(metrics)
            out.append((name, self.state.total, found))
        return out

    def is_empty(self) -> bool:
        return not any(self.state.bins)

    @property
    def total_samples(self) -> int:
        return math.floor(self.state.total)

    @property
    def n_bins(self) -> int:
        return self.baseline.n_bins

    def flush(self) -> None:
        require_flush(self.mode)
        self.state = self.state.flushed(self.clock())

    def last_flush(self) -> float:
        """Seconds since the window was emptied; 0 in decay mode."""
        return self.clock() - self.state.last_flush if isinstance(self.mode, Flush) else 0.0

    def reset_baseline(self, baseline: ContinuousBaseline | CategoricalBaseline) -> None:
        """A new baseline empties the window and restarts its clock."""
        self.baseline = baseline
        self.state = StreamState([0.0] * baseline.n_bins, last_flush=self.clock())
