"""As-of, nearest and around-a-point matching.

Both sides are merged into one ordered track and the right row is carried along it, so the cost is one sort
per chunk. There is no range join and no pair is ever built except the matching one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermofleet.functions.timekeys import add_seconds, seconds_between
from thermofleet.operators.track import Track, carry

SIDE = "__side"
MATCH = "__match"
AT = "__at"


def _merge(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str],
    tie: Sequence[str], right_first: bool,
) -> DataFrame:
    """One stream of left rows (boxed in `__left`) and right rows (boxed in `__match`)."""
    left_side, right_side = (1, 0) if right_first else (0, 1)
    rest = [c for c in left.columns if c not in by]
    lefts = left.select(
        *by,
        F.col(left_ts).alias(AT),
        F.lit(left_side).alias(SIDE),
        F.struct(*rest).alias("__left"),
    )
    rights = right.filter(F.col(right_ts).isNotNull()).select(
        *by,
        F.col(right_ts).alias(AT),
        F.lit(right_side).alias(SIDE),
        F.struct(F.col(right_ts).alias(AT), *values, *[F.col(t).alias(f"__tie_{t}") for t in tie]).alias(MATCH),
    )
    return lefts.unionByName(rights, allowMissingColumns=True)


def _track(by: Sequence[str], tie: Sequence[str]) -> Track:
    return Track(tuple(by), AT, (SIDE, *[f"__tie_{t}" for t in tie]))


def asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    values: Sequence[str],
    *,
    left_ts: str = "ts",
    right_ts: str = "ts",
    direction: str = "backward",
    allow_exact: bool = True,
    tolerance_seconds: int | None = None,
    tie: Sequence[str] = (),
    prefix: str = "right_",
) -> DataFrame:
    """Every left row with the latest right row at or before it (`backward`) or the first at or after (`forward`).

    `tie` orders right rows that share a timestamp (the last one wins backward, the first forward). Left rows
    without a match, or with one older than the tolerance, keep NULLs. Adds `{prefix}ts` and each value.
    """
    backward = direction == "backward"
    merged = _merge(left, right, by, left_ts, right_ts, values, tie, right_first=backward == allow_exact)
    for t in tie:
        merged = merged.withColumn(f"__tie_{t}", F.col(f"{MATCH}.__tie_{t}"))
    look = {"__found": F.col(MATCH)}
    track = _track(by, tie)
    found = carry(merged, track, last=look) if backward else carry(merged, track, following=look)
    found = found.filter(F.col("__left").isNotNull())
    if tolerance_seconds is not None:
        age = F.abs(seconds_between(F.col(AT), F.col(f"__found.{AT}")))
        found = found.withColumn("__found", F.when(age <= tolerance_seconds, F.col("__found")))
    return _unbox(left, found, by, values, prefix)


def _unbox(left: DataFrame, found: DataFrame, by: Sequence[str], values: Sequence[str], prefix: str) -> DataFrame:
    return found.select(
        *[F.col(c) if c in by else F.col(f"__left.{c}").alias(c) for c in left.columns],
        F.col(f"__found.{AT}").alias(f"{prefix}ts"),
        *[F.col(f"__found.{v}").alias(f"{prefix}{v}") for v in values],
    )


def nearest(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    values: Sequence[str],
    *,
    left_ts: str = "ts",
    right_ts: str = "ts",
    tolerance_seconds: float | None = None,
    inclusive: bool = True,
    prefix: str = "right_",
) -> DataFrame:
    """The right row closest in time; a tie goes to the earlier one. Right holds one row per key and time."""
    merged = _merge(left, right, by, left_ts, right_ts, values, (), right_first=True)
    found = carry(
        merged,
        _track(by, ()),
        last={"__back": F.col(MATCH)},
        following={"__ahead": F.col(MATCH)},
    ).filter(F.col("__left").isNotNull())
    back_gap = seconds_between(F.col(AT), F.col(f"__back.{AT}"))
    ahead_gap = seconds_between(F.col(f"__ahead.{AT}"), F.col(AT))
    use_back = F.col("__ahead").isNull() | (back_gap <= ahead_gap)
    found = found.withColumn("__found", F.when(use_back & F.col("__back").isNotNull(), F.col("__back")).otherwise(F.col("__ahead")))
    if tolerance_seconds is not None:
        gap = F.abs(seconds_between(F.col(f"__found.{AT}"), F.col(AT)))
        within = gap <= tolerance_seconds if inclusive else gap < tolerance_seconds
        found = found.withColumn("__found", F.when(within, F.col("__found")))
    return _unbox(left, found, by, values, prefix)


def forecast_at_horizons(
    refs: DataFrame, forecast: DataFrame, hours: Sequence[int], *, by: Sequence[str] = ("site_id",),
    values: Sequence[str] = ("temperature", "condition", "wind_speed", "cloud_coverage"),
    tolerance_seconds: int = 5_400,
) -> DataFrame:
    """One row per reference time and whole-hour horizon with the closest forecast entry within 90 minutes."""
    asked = refs.withColumn("horizon_hours", F.explode(F.array(*[F.lit(int(h)) for h in hours]))).withColumn(
        "wanted_ts", add_seconds(F.col("ts"), F.col("horizon_hours") * 3600)
    )
    out = nearest(
        asked, forecast, by, values, left_ts="wanted_ts", right_ts="target_ts",
        tolerance_seconds=tolerance_seconds, prefix="forecast_",
    )
    return out.withColumn("horizon", F.concat(F.col("horizon_hours").cast("string"), F.lit("h"))).drop("wanted_ts")


def lookup_actual(
    predicted: DataFrame, observed: DataFrame, by: Sequence[str], value: str, *, at: str = "target_ts",
    observed_ts: str = "ts", within_seconds: int = 180,
) -> DataFrame:
    """Exact-time value, else the first observation less than `within_seconds` away.

    "First" is the earliest row inside the open interval around the wanted time: the row that follows
    `wanted - within`, taken when it also lies before `wanted + within`.
    """
    exact = asof(
        predicted, observed, by, [value], left_ts=at, right_ts=observed_ts, tolerance_seconds=0, prefix="exact_",
    )
    probe = exact.withColumn("__from", add_seconds(F.col(at), -within_seconds))
    near = asof(
        probe, observed, by, [value], left_ts="__from", right_ts=observed_ts, direction="forward",
        allow_exact=False, prefix="near_",
    )
    close = seconds_between(F.col("near_ts"), F.col(at)) < within_seconds
    picked = F.when(F.col("exact_ts").isNotNull(), F.col(f"exact_{value}")).otherwise(
        F.when(close, F.col(f"near_{value}"))
    )
    return near.withColumn("actual", picked).drop("__from", "exact_ts", f"exact_{value}", "near_ts", f"near_{value}")


def around(df: DataFrame, point: Column, by: Sequence[str], before: int, after: int, ts: str = "ts",
           tie: Sequence[str] = ()) -> DataFrame:
    """The last `before` rows at or before a point in time and the first `after` rows past it, per key.

    Both rankings carry a limit that Spark applies before the shuffle, so a hot key sends only a few rows.
    """
    order = [F.col(ts), *[F.col(t) for t in tie]]
    past = Window.partitionBy(*by).orderBy(*[c.desc() for c in order])
    ahead = Window.partitionBy(*by).orderBy(*order)
    old = df.filter(F.col(ts) <= point).withColumn("__n", F.row_number().over(past)).filter(F.col("__n") <= before)
    new = df.filter(F.col(ts) > point).withColumn("__n", F.row_number().over(ahead)).filter(F.col("__n") <= after)
    return (
        old.withColumn("offset", 1 - F.col("__n")).unionByName(new.withColumn("offset", F.col("__n"))).drop("__n")
    )
