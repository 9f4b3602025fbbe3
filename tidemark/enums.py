"""Names of metrics, bin rules and column classes. `parse` is case-sensitive."""

from __future__ import annotations

from enum import Enum

from .errors import UnsupportedDriftType


class Named(str, Enum):
    @classmethod
    def parse(cls, name: str):
        try:
            return cls(name)
        except ValueError:
            raise UnsupportedDriftType(f"{name!r} is none of {', '.join(m.value for m in cls)}") from None


class QuantileType(Named):
    """Rules for the number of bins; the first is the default."""

    FREEDMAN_DIACONIS = "FreedmanDiaconis"
    SCOTT = "Scott"
    STURGES = "Sturges"


class ColumnClass(Named):
    CONTINUOUS = "Continuous"
    CATEGORICAL = "Categorical"


class ContinuousMetric(Named):
    """In the order of table results."""

    JENSEN_SHANNON = "JensenShannon"
    POPULATION_STABILITY_INDEX = "PopulationStabilityIndex"
    WASSERSTEIN_DISTANCE = "WassersteinDistance"
    KULLBACK_LEIBLER = "KullbackLeibler"
    KOLMOGOROV_SMIRNOV = "KolmogorovSmirnov"
    HELLINGER = "Hellinger"


class CategoricalMetric(Named):
    """In the order of table results."""

    JENSEN_SHANNON = "JensenShannon"
    POPULATION_STABILITY_INDEX = "PopulationStabilityIndex"
    WASSERSTEIN_DISTANCE = "WassersteinDistance"
    KULLBACK_LEIBLER = "KullbackLeibler"
    CHI_SQUARED = "ChiSquared"
    HELLINGER = "Hellinger"
    G_TEST = "GTest"


def metrics_of(column_class: ColumnClass) -> type[Named]:
    return ContinuousMetric if column_class is ColumnClass.CONTINUOUS else CategoricalMetric
