"""Exceptions of the library."""


class DriftError(Exception):
    """Base of all errors raised here."""


class EmptyBaselineData(DriftError):
    """A baseline needs data: at least two values for continuous columns, one for categorical ones."""


class EmptyRuntimeData(DriftError):
    """Drift needs at least one runtime value."""


class NaNValueError(DriftError):
    """A continuous baseline holds NaN or an infinity."""


class UnsupportedDriftType(DriftError):
    """No metric, bin rule or mode of that name."""


class UnsupportedTypeError(DriftError):
    """A column type that has no drift profile."""


class UnsupportedOperation(DriftError):
    """Not available in the stream's mode."""


class TooManyBins(DriftError):
    """The bin rule asks for more bins than a profile may have."""


class SchemaError(DriftError):
    """The candidate's schema differs from the baseline's; `report` says where."""

    def __init__(self, report) -> None:
        super().__init__(str(report))
        self.report = report


class InvalidDataShape(DriftError):
    """Bins, edges, values or stream bins of an export do not fit together."""


class InvalidDriftMode(DriftError):
    """An export of one stream mode was restored as the other."""


class DeserializationError(DriftError):
    """An export is no valid JSON, or lacks a field."""
