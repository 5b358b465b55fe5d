"""Complete time grids: resampling, filling and interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from thermofleet.functions.timekeys import floor_to
from thermofleet.operators.asof import asof
from thermofleet.operators.lookup import PAGE, spread_pages
from thermofleet.operators.track import Track, carry, numbered, over_rows

STEP = 300


def tick(ts: str = "ts", step_seconds: int = STEP) -> Column:
    """Row position on a complete grid."""
    return F.floor(F.unix_seconds(F.col(ts)) / step_seconds)


def grid(series: DataFrame, by: Sequence[str], step_seconds: int = STEP, start: Column | None = None,
         end: Column | None = None, ts: str = "ts") -> DataFrame:
    """Every step from the first to the last observation of a key (or between the given bounds).

    Spans become pages of ticks that are dealt over partitions before they unfold, so a long span is not built in one task.
    """
    span = series.groupBy(*by).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    lo = floor_to(start if start is not None else F.col("__lo"), step_seconds)
    hi = end if end is not None else F.col("__hi")
    reach = PAGE * step_seconds
    span = span.select(*by, F.unix_seconds(lo).alias("__first"), F.unix_seconds(hi).alias("__stop")).filter("__stop >= __first")
    ticks = F.floor((F.col("__stop") - F.col("__first")) / step_seconds) + 1
    begin = F.col("__first") + F.col("__page") * reach
    seconds = F.sequence(begin, F.least(begin + reach - step_seconds, F.col("__stop")), F.lit(step_seconds).cast("bigint"))
    return spread_pages(span, ticks, "__page", by).select(*by, F.explode(seconds).alias("__s")).select(
        *by, F.timestamp_seconds(F.col("__s")).alias(ts)
    )


def resample_ffill(series: DataFrame, by: Sequence[str], value: str = "value", step_seconds: int = STEP,
                   start: Column | None = None, end: Column | None = None, ts: str = "ts",
                   tie: Sequence[str] = (), missing: Column | None = None) -> DataFrame:
    """Last known value at or before every tick. Among equal timestamps the last by `tie` counts.

    `missing` fills ticks before the first observation (boolean series use false).
    """
    ticks = grid(series, by, step_seconds, start, end, ts)
    known = series.filter(F.col(value).isNotNull())
    out = asof(ticks, known, by, [value], left_ts=ts, right_ts=ts, tie=tie)
    filled = F.col(f"right_{value}") if missing is None else F.coalesce(F.col(f"right_{value}"), missing)
    return out.withColumn(value, filled).drop(f"right_{value}", "right_ts")


def forward_fill(df: DataFrame, track: Track, columns: Sequence[str]) -> DataFrame:
    """Sparse columns hold their last value; what precedes the first one stays NULL."""
    filled = carry(df, track, last={f"__fill_{c}": F.col(c) for c in columns})
    return filled.withColumns({c: F.col(f"__fill_{c}") for c in columns}).drop(*[f"__fill_{c}" for c in columns])


def interpolate(df: DataFrame, track: Track, column: str, limit: int = 24, position: Column | None = None,
                into: str | None = None) -> DataFrame:
    """Linear by row position, at most `limit` rows past a known value.

    Rows before the first known value stay NULL; rows past the last one hold it (same limit).
    """
    into = into or column
    at = "__pos"
    placed = numbered(df, track, at, keep_chunk=True) if position is None else df.withColumn(at, position)
    known = F.when(F.col(column).isNotNull(), F.struct(F.col(at).alias("p"), F.col(column).alias("v")))
    seen = carry(placed, track, last={"__lo": known}, following={"__hi": known})
    gap = F.col(at) - F.col("__lo.p")
    slope = (F.col("__hi.v") - F.col("__lo.v")) / (F.col("__hi.p") - F.col("__lo.p"))
    value = (
        F.when(F.col(column).isNotNull(), F.col(column))
        .when(gap <= limit, F.when(F.col("__hi").isNull(), F.col("__lo.v")).otherwise(F.col("__lo.v") + slope * gap))
    )
    return seen.withColumn(into, value).drop(at, "__lo", "__hi")


def horizon_value(df: DataFrame, by: Sequence[str], columns: Sequence[str], steps: Sequence[int], step_seconds: int = STEP,
                  ts: str = "ts") -> DataFrame:
    """Values `h` steps ahead on a complete grid as `{column}_t+{h}`, all horizons on one partitioning."""

    def ahead(window: WindowSpec) -> dict[str, Column]:
        return {f"{c}_t+{h}": F.lead(c, h).over(window) for c in columns for h in steps}

    return over_rows(df, Track(tuple(by), ts), 0, max(steps), [ahead], tick(ts, step_seconds))
