"""Runs in time: gap sessions, state spans, change points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermofleet.functions.timekeys import seconds_between
from thermofleet.operators.track import Track, carry, previous


def gap_segments(df: DataFrame, track: Track, gap_seconds: float = 600, min_rows: int = 0,
                 into: str = "segment_id") -> DataFrame:
    """Number the runs of a series: a gap longer than `gap_seconds` starts a new one; short runs are dropped."""
    ts = F.col(track.ts)
    linked = previous(df, track, {"__prev": ts}, keep_chunk=True)
    broke = F.when(seconds_between(ts, F.col("__prev")) > gap_seconds, 1).otherwise(0).cast("bigint")
    tagged = carry(linked, track, total={into: broke}).drop("__prev")
    if min_rows <= 1:
        return tagged
    sizes = tagged.groupBy(*track.by, into).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_rows)
    return tagged.join(sizes.drop("__n"), [*track.by, into], "left_semi")


def segment_summary(segments: DataFrame, by: Sequence[str], ts: str = "ts", segment: str = "segment_id") -> DataFrame:
    return segments.groupBy(*by, segment).agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n_rows")
    )


def state_spans(df: DataFrame, track: Track, state: str = "state") -> DataFrame:
    """Contiguous runs of one value: start, end, row count."""
    linked = previous(df, track, {"__prev": F.col(state), "__any": F.lit(1)}, keep_chunk=True)
    changed = F.col("__any").isNull() | ~F.col(state).eqNullSafe(F.col("__prev"))
    tagged = carry(linked, track, total={"run_no": changed.cast("bigint")})
    return tagged.groupBy(*track.by, "run_no").agg(
        F.min_by(state, track.order_key()).alias(state),
        F.min(track.ts).alias("start_ts"),
        F.max(track.ts).alias("end_ts"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def change_only(df: DataFrame, track: Track, value: str = "value") -> DataFrame:
    """Drop a row that repeats the previous value of its series."""
    linked = previous(df, track, {"__prev": F.col(value), "__any": F.lit(1)})
    keep = F.col("__any").isNull() | ~F.col(value).eqNullSafe(F.col("__prev"))
    return linked.filter(keep).drop("__prev", "__any")


def last_change_time(df: DataFrame, track: Track, mode: str, into: str = "mode_since") -> DataFrame:
    """When the current mode was first seen in its run."""
    linked = previous(df, track, {"__prev": F.col(mode), "__any": F.lit(1)}, keep_chunk=True)
    changed = F.col("__any").isNull() | ~F.col(mode).eqNullSafe(F.col("__prev"))
    return carry(linked, track, last={into: F.when(changed, F.col(track.ts))}).drop("__prev", "__any")


def keep_last(df: DataFrame, by: Sequence[str], arrival: str) -> DataFrame:
    """One row per key, the last to arrive. Combined before the shuffle, so copies of one key stay cheap."""
    rest = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("__row"))
    return picked.select(*by, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def keep_first(df: DataFrame, by: Sequence[str], arrival: str) -> DataFrame:
    """One row per key, the first to arrive."""
    rest = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.col(arrival)).alias("__row"))
    return picked.select(*by, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank",
          mandatory: Column | None = None) -> DataFrame:
    """Best `k` rows per key plus the mandatory ones. The rank limit is applied before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    best = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
    if mandatory is None:
        return best
    forced = df.filter(mandatory).withColumn(rank, F.lit(None).cast("int"))
    both = best.unionByName(forced)
    rest = [c for c in df.columns]
    return both.groupBy(*rest).agg(F.min(rank).alias(rank))


def tail_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 18) -> DataFrame:
    """The newest `n` rows per key."""
    window = Window.partitionBy(*by).orderBy(*[c.desc() for c in order])
    return df.withColumn("age_rank", F.row_number().over(window)).filter(F.col("age_rank") <= n)


def durbin_watson(df: DataFrame, track: Track, residual: str, by: Sequence[str] | None = None) -> DataFrame:
    """Sum of squared first differences over the sum of squares, in row order."""
    linked = previous(df, track, {"__prev": F.col(residual)})
    diff = F.col(residual) - F.col("__prev")
    return linked.groupBy(*(by or track.by)).agg(
        (
            F.coalesce(F.sum(diff * diff), F.lit(0.0))
            / F.greatest(F.sum(F.col(residual) * F.col(residual)), F.lit(1e-30))
        ).alias("durbin_watson")
    )
