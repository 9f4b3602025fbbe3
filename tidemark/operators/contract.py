"""Thresholds on drift results, and the health state they give."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..enums import CategoricalMetric, ContinuousMetric, Named


class DriftState(str, Enum):
    HEALTHY = "Healthy"
    PARTIALLY_HEALTHY = "PartiallyHealthy"
    UNHEALTHY = "Unhealthy"


@dataclass(frozen=True)
class Evaluation:
    """A result against its threshold; delta is how far above it is, None if it passed."""

    metric: Named
    delta: float | None

    @property
    def passed(self) -> bool:
        return self.delta is None


@dataclass(frozen=True)
class DriftCheck:
    results: list[Evaluation]
    state: DriftState
    null_delta: float | None = None

    @property
    def nulls_passed(self) -> bool:
        return self.null_delta is None


def state_of(passed: int, failed: int) -> DriftState:
    """All passed (also if there is nothing): healthy; all failed: unhealthy."""
    return DriftState.HEALTHY if not failed else DriftState.UNHEALTHY if not passed else DriftState.PARTIALLY_HEALTHY


def field_of(metric: Named) -> str:
    return metric.name.lower()


@dataclass(frozen=True)
class Contract:
    """Thresholds are upper bounds, themselves allowed. Unset ones take the defaults (fixed values)."""

    jensen_shannon: float = 0.1
    population_stability_index: float = 0.25
    wasserstein_distance: float = 0.1
    kullback_leibler: float = 0.2
    hellinger: float = 0.1

    def threshold(self, metric: Named) -> float:
        return getattr(self, field_of(metric))

    def check(self, results: Iterable[tuple[Named, float]], null_percentage: float | None = None) -> DriftCheck:
        """NaN results pass. The state follows the metrics alone; a null share above its threshold is reported beside it."""
        done = [Evaluation(m, d if (d := v - self.threshold(m)) > 0 else None) for m, v in results]
        failed = sum(not e.passed for e in done)
        limit = getattr(self, "null_percentage", None)
        over = null_percentage - limit if limit is not None and null_percentage is not None and null_percentage > limit else None
        return DriftCheck(done, state_of(len(done) - failed, failed), over)

    def thresholds(self) -> dict[str, float]:
        """By metric name."""
        kinds = ContinuousMetric if hasattr(self, "kolmogorov_smirnov") else CategoricalMetric
        return {m.value: self.threshold(m) for m in kinds}

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str):
        return cls(**json.loads(text))


@dataclass(frozen=True)
class ContinuousContract(Contract):
    kolmogorov_smirnov: float = 0.1


@dataclass(frozen=True)
class CategoricalContract(Contract):
    chi_squared: float = 10.0
    g_test: float = 10.0


@dataclass(frozen=True)
class NullableContinuousContract(ContinuousContract):
    null_percentage: float = 0.1


@dataclass(frozen=True)
class NullableCategoricalContract(CategoricalContract):
    null_percentage: float = 0.1


class ContractBuilder:
    """`ContractBuilder(ContinuousContract).with_hellinger(0.2).build()`: a with_ method for each threshold of the contract."""

    def __init__(self, contract: type[Contract]) -> None:
        self._contract, self._set = contract, {}

    def __getattr__(self, name: str):
        threshold = name.removeprefix("with_")
        if name == threshold or threshold not in self._contract.__dataclass_fields__:
            raise AttributeError(name)

        def put(value: float) -> ContractBuilder:
            self._set[threshold] = value
            return self

        return put

    def build(self) -> Contract:
        return self._contract(**self._set)


def _threshold_column(continuous: Contract, categorical: Contract, column_class: Column) -> Column:
    pick = lambda c: F.create_map(*[F.lit(x) for pair in c.thresholds().items() for x in pair])[F.col("metric")]
    return F.when(column_class == "Continuous", pick(continuous)).otherwise(pick(categorical))


def evaluate_table(drift: DataFrame, continuous: Contract | None = None, categorical: Contract | None = None) -> DataFrame:
    """Table drift rows with threshold, delta and result (Passed or Failed). Lazy, no shuffle."""
    continuous, categorical = continuous or NullableContinuousContract(), categorical or NullableCategoricalContract()
    judged = drift.withColumn("threshold", _threshold_column(continuous, categorical, F.col("column_class")))
    delta = F.col("drift_magnitude") - F.col("threshold")
    failed = (delta > 0) & ~F.isnan(delta)
    return judged.withColumns({"delta": F.when(failed, delta), "result": F.when(failed, "Failed").otherwise("Passed")})


def column_states(evaluated: DataFrame, null_limit: float = 0.1) -> DataFrame:
    """(column, passed, failed, state, null_state)."""
    counts = evaluated.groupBy("column").agg(F.count_if(F.col("result") == "Passed").alias("passed"), F.count_if(F.col("result") == "Failed").alias("failed"), F.max("null_percentage").alias("_nulls"))
    state = F.when(F.col("failed") == 0, DriftState.HEALTHY.value).when(F.col("passed") == 0, DriftState.UNHEALTHY.value).otherwise(DriftState.PARTIALLY_HEALTHY.value)
    return counts.select("column", "passed", "failed", state.alias("state"), F.when(F.col("_nulls") > null_limit, "Failed").otherwise("Passed").alias("null_state"))
