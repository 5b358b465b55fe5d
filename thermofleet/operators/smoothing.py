"""Positional derivatives, rolling means and lag bins on a complete grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from thermofleet.operators.track import Track, over_rows

HOURS_PER_STEP = 5.0 / 60.0


def central_difference(window: WindowSpec, column: str, step_hours: float = HOURS_PER_STEP) -> Column:
    """`(next - previous) / 2 steps`; one-sided at the ends of the series."""
    x = F.col(column)
    ahead, back = F.lead(x, 1).over(window), F.lag(x, 1).over(window)
    has_ahead = F.lead(F.lit(1), 1).over(window).isNotNull()
    has_back = F.lag(F.lit(1), 1).over(window).isNotNull()
    return (
        F.when(has_ahead & has_back, (ahead - back) / (2 * step_hours))
        .when(has_ahead, (ahead - x) / step_hours)
        .when(has_back, (x - back) / step_hours)
    )


def rolling_mean(window: WindowSpec, column: str, half: int = 3, min_count: int = 4) -> Column:
    frame = window.rowsBetween(-half, half)
    return F.when(F.count(column).over(frame) >= min_count, F.avg(column).over(frame))


def wide_difference(window: WindowSpec, column: str, half: int = 3, step_hours: float = HOURS_PER_STEP) -> Column:
    """`(x[+half] - x[-half])` over its span; NULL where either end is missing."""
    x = F.col(column)
    return (F.lead(x, half).over(window) - F.lag(x, half).over(window)) / (2 * half * step_hours)


# Lag-bin edges in 5-minute steps by the largest number of steps they serve; the last edge is that number.
LAG_EDGES = [(1, [0]), (3, [0, 1]), (6, [0, 3])]
LONG_LAG_EDGES = [0, 3, 6, 12]


def lag_bins(max_lag_minutes: int) -> list[tuple[int, int]]:
    """Step ranges `[start, end)` that cover a lag: finer near zero, coarser for slow devices."""
    steps = max(1, max_lag_minutes // 5)
    edges = [*next((e for most, e in LAG_EDGES if steps <= most), LONG_LAG_EDGES), steps]
    return list(zip(edges, edges[1:]))


def bin_label(start: int, end: int) -> str:
    return f"{start * 5}_{end * 5}"


def lag_bin_mean(window: WindowSpec, column: str, start: int, end: int) -> Column:
    """Mean over rows `start..end-1` steps back; missing rows count as zero."""
    frame = window.rowsBetween(-(end - 1), -start)
    return F.coalesce(F.sum(F.coalesce(F.col(column), F.lit(0.0))).over(frame), F.lit(0.0)) / float(max(end - start, 1))


def difference_features(df: DataFrame, track: Track, column: str, spans: Sequence[int] = (3, 6, 12),
                        position: Column | None = None) -> DataFrame:
    """Change over several spans and the second difference."""
    x = F.col(column)

    def build(window: WindowSpec) -> Mapping[str, Column]:
        out = {f"{column}_d{n}": x - F.lag(x, n).over(window) for n in spans}
        out[f"{column}_dd"] = x - 2 * F.lag(x, 1).over(window) + F.lag(x, 2).over(window)
        return out

    return over_rows(df, track, max(*spans, 2), 0, [build], position)


def smoothed_rate(df: DataFrame, track: Track, column: str, into: str, half: int = 3,
                  step_hours: float = HOURS_PER_STEP, position: Column | None = None) -> DataFrame:
    """Rolling mean, then the wide difference, on one partitioning.

    The first and last `half` rows of a series get NULL because their lag or lead does not exist.
    """
    return over_rows(
        df, track, 2 * half, 2 * half,
        [
            lambda w: {"__smooth": rolling_mean(w, column, half, half + 1)},
            lambda w: {into: wide_difference(w, "__smooth", half, step_hours)},
        ],
        position,
    ).drop("__smooth")
