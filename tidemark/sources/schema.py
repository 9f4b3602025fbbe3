"""Column types, their class, and the exact schema match between baseline and candidate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..enums import ColumnClass
from ..errors import SchemaError, UnsupportedTypeError

CONTINUOUS_TYPES = (T.FloatType, T.DoubleType)
CATEGORICAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType)


def class_of(kind: T.DataType) -> ColumnClass:
    """Floating point is continuous; integers, strings and booleans are categorical.

    Unsigned 64-bit integers arrive as decimal(20, 0) and are categorical; other decimals have no profile."""
    if isinstance(kind, CONTINUOUS_TYPES):
        return ColumnClass.CONTINUOUS
    if isinstance(kind, CATEGORICAL_TYPES) or kind == T.DecimalType(20, 0):
        return ColumnClass.CATEGORICAL
    raise UnsupportedTypeError(f"no profile for columns of type {kind.simpleString()}")


@dataclass(frozen=True)
class SchemaReport:
    """All differences at once; names in alphabetical order."""

    invalid_type_columns: list[tuple[str, str, str]] = field(default_factory=list)  # name, expected, found
    missing_baseline_columns: list[str] = field(default_factory=list)
    extra_candidate_columns: list[str] = field(default_factory=list)

    @property
    def valid(self) -> bool:
        return not (self.invalid_type_columns or self.missing_baseline_columns or self.extra_candidate_columns)


def compare_schema(expected: dict[str, str], candidate: T.StructType) -> SchemaReport:
    """expected: name -> simple type string. Column order and nullability do not matter. No job runs."""
    found = {f.name: f.dataType.simpleString() for f in candidate.fields}
    return SchemaReport(
        [(c, expected[c], found[c]) for c in sorted(expected.keys() & found.keys()) if expected[c] != found[c]],
        sorted(expected.keys() - found.keys()),
        sorted(found.keys() - expected.keys()),
    )


def require_schema(expected: dict[str, str], candidate: T.StructType) -> None:
    report = compare_schema(expected, candidate)
    if not report.valid:
        raise SchemaError(report)
