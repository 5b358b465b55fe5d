"""Ordered series that are cut by rows, so that no task ever holds one key's whole history.

A plain window `partitionBy(site)` puts a site's entire history in one task. The functions here deal the rows into ranges
of the full order `(key, time, tie)` whose borders Spark samples from the rows themselves, so a dense hour, or many rows
at one instant, is cut like any other stretch. Ordinary windows run inside `(key, range)`, and what crosses a border is
carried through a table with one row per range. The answer equals the unsplit window; the largest task is one range. The
cut is a reliable checkpoint: every later look at the rows, and every retry, sees the same ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from thermofleet.session import cut_lineage

CHUNK = "__chunk"
BLOCK = "__block"
HOME = "__home"
POSITION = "__position"
EACH = "__each"
LARGE = 500_000  # rows of a table that is cut by its own number of rows, not into shuffle partitions
RANGE_ROWS = 100_000


@dataclass(frozen=True)
class Track:
    """Rows sharing `by`, ordered by `(ts, *tie)`. `tie` must make the order total where ts repeats."""

    by: tuple[str, ...]
    ts: str = "ts"
    tie: tuple[str, ...] = ()
    block_rows: int = 4_096

    def chunked(self, df: DataFrame) -> DataFrame:
        """Add the number of the row's range, or keep the one an earlier step left.

        Ranges of a small table hold about as many rows as Spark puts in a shuffle partition; beyond `LARGE` rows a range holds
        `RANGE_ROWS`, however many there are. Rows of one key in one range are one chunk.
        A number per row comes last in the order of the cut, so that rows of one instant, equal ones too, are cut like others.
        """
        if CHUNK in df.columns:
            return df
        n = df.count()
        ranges = [-(-n // RANGE_ROWS)] if n > LARGE else []
        numbered_rows = df.withColumn(EACH, F.monotonically_increasing_id())
        dealt = numbered_rows.repartitionByRange(*ranges, *self.by, *self.order(), EACH).withColumn(CHUNK, F.spark_partition_id().cast("bigint"))
        return cut_lineage(dealt.drop(EACH))

    def order(self) -> list[Column]:
        return [F.col(c) for c in (self.ts, *self.tie)]

    def order_key(self) -> Column:
        return F.struct(*self.order()) if self.tie else F.col(self.ts)

    def chunk_keys(self) -> list[str]:
        return [*self.by, CHUNK]


def carry(
    df: DataFrame,
    track: Track,
    *,
    last: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    keep_chunk: bool = False,
) -> DataFrame:
    """Series-wide looks, exact across chunk borders.

    `last` / `before`: latest non-null value at or before / strictly before the row. `following` / `after`: the
    mirror image. `total`: running sum including the row. Rows are distinguished by the track's full order.
    """
    looks = {
        "last": dict(last or {}),
        "before": dict(before or {}),
        "following": dict(following or {}),
        "after": dict(after or {}),
        "total": dict(total or {}),
    }
    names = [(kind, out) for kind, items in looks.items() for out in items]
    base = track.chunked(df)
    # ranges of a large table meet again in as many partitions, which are not merged at run time
    ranges = base.rdd.getNumPartitions() if CHUNK not in df.columns else 0
    base = base.withColumns({f"__in_{kind}_{out}": looks[kind][out] for kind, out in names})

    keys = track.chunk_keys()
    key = track.order_key()
    border: list[Column] = []
    for kind, out in names:
        value = F.col(f"__in_{kind}_{out}")
        seen = F.when(value.isNotNull(), key)
        if kind in ("last", "before"):
            border.append(F.max_by(value, seen).alias(f"__edge_{kind}_{out}"))
        elif kind in ("following", "after"):
            border.append(F.min_by(value, seen).alias(f"__edge_{kind}_{out}"))
        else:
            border.append(F.sum(value).alias(f"__edge_{kind}_{out}"))
    edges = base.groupBy(*keys).agg(*border)

    # One row per chunk: what every chunk receives from its neighbours.
    past = Window.partitionBy(*track.by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*track.by).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    received = edges.select(
        *keys,
        *[
            (
                F.sum(f"__edge_{kind}_{out}").over(past)
                if kind == "total"
                else F.last(f"__edge_{kind}_{out}", ignorenulls=True).over(
                    past if kind in ("last", "before") else future
                )
            ).alias(f"__from_{kind}_{out}")
            for kind, out in names
        ],
    )

    inside = Window.partitionBy(*keys)
    up = inside.orderBy(*track.order())
    down = inside.orderBy(*[c.desc() for c in track.order()])
    frames = {
        "last": up.rowsBetween(Window.unboundedPreceding, 0),
        "before": up.rowsBetween(Window.unboundedPreceding, -1),
        "following": down.rowsBetween(Window.unboundedPreceding, 0),
        "after": down.rowsBetween(Window.unboundedPreceding, -1),
        "total": up.rowsBetween(Window.unboundedPreceding, 0),
    }
    placed = base.repartition(ranges, *keys) if ranges > LARGE // RANGE_ROWS else base
    local = placed.select(
        *df.columns,
        *([] if CHUNK in df.columns else [CHUNK]),
        *[
            (
                F.sum(f"__in_{kind}_{out}").over(frames[kind])
                if kind == "total"
                else F.last(f"__in_{kind}_{out}", ignorenulls=True).over(frames[kind])
            ).alias(f"__here_{kind}_{out}")
            for kind, out in names
        ],
    )
    joined = local.join(received, keys, "left")
    kept = [c for c in local.columns if not c.startswith("__here_") and (keep_chunk or c != CHUNK)]
    result = []
    for kind, out in names:
        here, came = F.col(f"__here_{kind}_{out}"), F.col(f"__from_{kind}_{out}")
        if kind == "total":
            zero = F.lit(0)
            result.append((F.coalesce(here, zero) + F.coalesce(came, zero)).alias(out))
        else:
            result.append(F.coalesce(here, came).alias(out))
    return joined.select(*[c for c in kept if c not in {out for _, out in names}], *result)


def previous(df: DataFrame, track: Track, columns: Mapping[str, Column], keep_chunk: bool = False) -> DataFrame:
    """The preceding row's values (NULL values included), as `lag(1)` over the whole series would give."""
    boxed = carry(
        df, track, before={f"__box_{k}": F.struct(v.alias("v")) for k, v in columns.items()}, keep_chunk=keep_chunk
    )
    return boxed.withColumns({k: F.col(f"__box_{k}.v") for k in columns}).drop(*[f"__box_{k}" for k in columns])


def numbered(df: DataFrame, track: Track, name: str = POSITION, keep_chunk: bool = False) -> DataFrame:
    """1-based position of each row in its series."""
    return carry(df, track, total={name: F.lit(1).cast("bigint")}, keep_chunk=keep_chunk)


def over_rows(
    df: DataFrame,
    track: Track,
    reach_back: int,
    reach_ahead: int,
    steps: Sequence[Callable[[WindowSpec], Mapping[str, Column]]],
    position: Column | None = None,
) -> DataFrame:
    """Windows with a bounded row reach: lags, leads, rolling frames.

    Rows are cut into blocks by position; rows near a border are also handed to the neighbouring block, so a
    frame never lacks a row it should see. `steps` run one after the other on the same partitioning, each
    receiving the block window. Give `position` on a complete grid (tick number); otherwise rows are counted.
    """
    size = max(track.block_rows, reach_back, reach_ahead)
    placed = numbered(df, track) if position is None else df.withColumn(POSITION, position.cast("bigint"))
    home = F.floor(F.col(POSITION) / size)
    copies = [home]
    if reach_back:
        copies.append(F.when(F.col(POSITION) >= (home + 1) * size - reach_back, home + 1))
    if reach_ahead:
        copies.append(F.when(F.col(POSITION) < home * size + reach_ahead, home - 1))
    spread = placed.withColumn(HOME, home).withColumn(BLOCK, F.explode(F.array_compact(F.array(*copies))))
    window = Window.partitionBy(*track.by, BLOCK).orderBy(POSITION, *track.order())
    for step in steps:
        spread = spread.withColumns(dict(step(window)))
    return spread.filter(F.col(BLOCK) == F.col(HOME)).drop(BLOCK, HOME, POSITION)
