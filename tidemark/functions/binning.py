"""Bin-count rules, bin edges and the bin of a value.

Edges: n_bins - 1 of them, the first at the minimum, each one step further, step = range / n_bins, added up in the column's own
precision. Bin of a value: the number of edges not above it, so bin 0 is below the baseline's minimum and the last bin
holds the top two steps and everything above."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..enums import QuantileType
from ..errors import EmptyBaselineData, NaNValueError, TooManyBins

#: Single-precision literals of the rules, also in double precision.
CUBE_ROOT = np.float32(-1) / np.float32(3)
SCOTT_FACTOR = np.float32(3.49)
LEAST_BINS = 3
#: A profile with more bins than this is refused.
MOST_BINS = 5_000_000
#: Up to this many rows, order statistics are taken by one exact aggregate; beyond it the range is narrowed first.
EXACT_ROWS = 50_000


@dataclass(frozen=True)
class Summary:
    """What bin rules need of a column: rows, non-null values, range, deviation, quartiles by index (if asked for)."""

    rows: int
    values: int
    low: float
    high: float
    deviation: float
    quartiles: tuple[float, float] | None
    single: bool  # a FloatType column: edges in single precision


def quartile_ranks(n: int) -> tuple[int, int]:
    """Places of the quartiles in the sorted values, without interpolation."""
    return math.floor(0.25 * n), min(math.floor(0.75 * n), n - 1)


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _disc(column: str, rank: int, n: int, where: str = "true") -> Column:
    """sorted(values where ...)[rank] of n values: exact, keeps their distinct values."""
    return F.expr(f"percentile_disc({(rank + 0.5) / n!r}) WITHIN GROUP (ORDER BY {_name(column)}) FILTER (WHERE {where})")


def _bracket(column: str, share: float) -> Column:
    """Values a little below and above a share of the column, by a mergeable sketch."""
    margin = 1 / 2000
    return F.percentile_approx(_name(column), [max(0.0, share - margin), min(1.0, share + margin)], 10_000)


def order_statistics_of(
    df: DataFrame, wanted: dict[str, tuple[Sequence[int], int]], exact_rows: int = EXACT_ROWS, brackets: dict[tuple[str, int, int], list[float]] | None = None
) -> dict[str, list[float]]:
    """sorted(column)[k] for ranks k of columns with n values each, exactly; wanted: column -> (ranks, n). Nulls do not count.

    Few values: one aggregate, which keeps the distinct ones. More: a mergeable sketch brackets each rank, counts below the bracket
    turn it into a rank inside, and the aggregate sees only the rows in the bracket, about a thousandth. All columns share these
    three passes; the first falls away if the caller has the brackets, by (column, rank, n). Where a bracket still holds more than `exact_rows` values, or missed, that rank is narrowed further by itself."""
    asked = [(c, k, n) for c, (ranks, n) in wanted.items() for k in ranks]
    large = [x for x in asked if x[2] > exact_rows]
    picks: dict[tuple[str, int], Column] = {(c, k): _disc(c, k, n) for c, k, n in asked if n <= exact_rows}
    found: dict[tuple[str, int], float] = {}
    if large:
        if brackets is None:
            brackets = dict(zip(large, df.agg(*[_bracket(c, k / n).alias(f"b{i}") for i, (c, k, n) in enumerate(large)]).first(), strict=True))
        counts = []
        for i, (c, _, _) in enumerate(large):
            value, (low, high) = F.col(_name(c)), brackets[large[i]]
            counts += [F.count_if(value < low).alias(f"u{i}"), F.count_if((value >= low) & (value <= high)).alias(f"i{i}")]
        sizes = df.agg(*counts).first()
        for i, (c, k, n) in enumerate(large):
            (low, high), below, inside = brackets[c, k, n], sizes[2 * i], sizes[2 * i + 1]
            if below <= k < below + inside and low == high:
                found[c, k] = low
            elif below <= k < below + inside <= below + exact_rows:
                picks[c, k] = _disc(c, k - below, inside, f"{_name(c)} BETWEEN {low!r}D AND {high!r}D")
            else:
                found[c, k] = _by_counts(df.select(F.col(_name(c)).cast("double").alias("v")).where("v IS NOT NULL"), "v", k, n)
    if picks:
        found |= dict(zip(picks, df.agg(*[p.alias(f"p{i}") for i, p in enumerate(picks.values())]).first(), strict=True))
    return {c: [found[c, k] for k in ranks] for c, (ranks, _) in wanted.items()}


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int], n: int, exact_rows: int = EXACT_ROWS) -> list[float]:
    return order_statistics_of(df, {column: (ranks, n)}, exact_rows)[column]


def _by_counts(df: DataFrame, column: str, rank: int, n: int) -> float:
    """Order statistic by halving the value range with counts: some sixty passes at most, each over a column."""
    value = F.col(column)
    low, high = df.agg(F.min(value), F.max(value)).first()
    while low < high:
        middle = low + (high - low) / 2
        count, upto, above = df.agg(F.count_if(value <= middle), F.max(F.when(value <= middle, value)), F.min(F.when(value > middle, value))).first()
        if rank < count:
            if high == upto:
                return high
            high = upto
        else:
            low = above
        df = df.where((value >= low) & (value <= high))
        rank = rank if rank < count else rank - count
    return low


def summarise_all(df: DataFrame, rules: dict[str, QuantileType], singles: dict[str, bool], exact_rows: int = EXACT_ROWS) -> dict[str, Summary]:
    """Summaries of several columns: one aggregation for all, and the quartiles of those whose rule needs them together."""
    parts = [F.count("*")]
    for c in rules:
        value = F.col(_name(c))
        wide = value.cast("double")
        parts += [F.count(value), F.count_if(F.isnan(value) | (F.abs(wide) == float("inf"))), F.min(wide), F.max(wide), F.stddev_samp(wide)]
    sketched = [c for c, rule in rules.items() if rule is QuantileType.FREEDMAN_DIACONIS]
    parts += [_bracket(c, share) for c in sketched for share in (0.25, 0.75)]
    rows, *row = df.agg(*[p.alias(f"s{i}") for i, p in enumerate(parts)]).first()
    stats = {c: row[5 * i : 5 * i + 5] for i, c in enumerate(rules)}
    for c, (values, odd_values, *_) in stats.items():
        if values < 2:
            raise EmptyBaselineData(f"{c}: a continuous baseline needs at least two values, not {values}")
        if odd_values:
            raise NaNValueError(f"{c}: the baseline holds {odd_values} NaN or infinite values")
    ranked = {c: (quartile_ranks(stats[c][0]), stats[c][0]) for c, rule in rules.items() if rule is QuantileType.FREEDMAN_DIACONIS}
    near = row[5 * len(rules) :]
    brackets = {(c, k, ranked[c][1]): near[2 * i + j] for i, c in enumerate(sketched) for j, k in enumerate(ranked[c][0])}
    quartiles = order_statistics_of(df.select([F.col(_name(c)).cast("double").alias(c) for c in ranked]), ranked, exact_rows, brackets) if ranked else {}
    return {c: Summary(rows, values, low, high, deviation, tuple(quartiles[c]) if c in quartiles else None, singles[c]) for c, (values, _, low, high, deviation) in stats.items()}


def summarise(df: DataFrame, column: str, rule: QuantileType, single: bool, exact_rows: int = EXACT_ROWS) -> Summary:
    return summarise_all(df, {column: rule}, {column: single}, exact_rows)[column]


def bin_count(s: Summary, rule: QuantileType) -> int:
    number = np.float32 if s.single else np.float64
    if rule is QuantileType.STURGES:
        return max(math.floor(number(np.log2(number(s.values)))) + 1, LEAST_BINS)
    spread = number(s.high) - number(s.low)
    scale = np.power(number(s.values), number(CUBE_ROOT))
    if rule is QuantileType.SCOTT:
        if s.low == s.high:
            return LEAST_BINS
        width = number(SCOTT_FACTOR) * number(s.deviation) * scale
    else:
        iqr = number(s.quartiles[1]) - number(s.quartiles[0])
        if iqr == 0:
            return LEAST_BINS
        width = number(2) * iqr * scale
    bins = np.ceil(spread / width) if width > 0 else math.inf
    if not np.isfinite(bins) or bins > MOST_BINS:
        raise TooManyBins(f"the {rule.value} rule asks for {bins:g} bins; a profile has {MOST_BINS} at most")
    return max(int(bins), LEAST_BINS)


def bin_edges(low: float, high: float, n_bins: int, single: bool = False) -> list[float]:
    number = np.float32 if single else np.float64
    step = (number(high) - number(low)) / number(n_bins)
    edges = np.full(n_bins - 1, step, number)
    edges[0] = number(low)
    return np.cumsum(edges, dtype=number).tolist()  # cumulative sums add in order


def edges_literal(edges: Sequence[float]) -> Column:
    """The edges as one constant array (folded by the optimizer), not an expression per edge."""
    return F.expr(f"cast(split('{','.join(map(repr, edges))}', ',') AS array<double>)")


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Bin of a value as int; null for null, 0 for NaN.

    A guess by arithmetic, put right by one against the true edges: constant work per row whatever the number of bins. Edges that
    are not evenly spaced (given by the caller) are searched by counting."""
    n = len(edges) + 1
    wide = value.cast("double")
    step = (edges[-1] - edges[0]) / (n - 2) if n > 2 else 0.0
    if step == 0:
        found = F.when(wide >= edges[-1], F.lit(n - 1)).otherwise(F.size(F.filter(edges_literal(edges), lambda e: e <= wide)) if n > 2 and edges[0] != edges[-1] else F.lit(0))
    elif max(abs(a - (edges[0] + i * step)) for i, a in enumerate(edges)) > step / 2:
        found = F.size(F.filter(edges_literal(edges), lambda e: e <= wide))
    else:
        at = edges_literal(edges)
        guess = F.floor(F.least(F.greatest((wide - edges[0]) / step, F.lit(-1.0)), F.lit(float(n - 2)))).cast("int")
        too_high = (guess >= 0) & (F.get(at, F.greatest(guess, F.lit(0))) > wide)
        too_low = (guess < n - 2) & (F.get(at, F.least(guess + 1, F.lit(n - 2))) <= wide)
        found = guess + 1 - too_high.cast("int") + too_low.cast("int")
    return F.when(value.isNull(), None).when(F.isnan(wide), F.lit(0)).otherwise(found.cast("int"))
