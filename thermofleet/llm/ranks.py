"""Row numbers within groups of any size: the rows are cut into ranges of their order, and each range starts where the ranges
before it end. The starts travel as rows of their own, so nothing is joined and no window holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from thermofleet.llm.tables import stored


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank", total: str = "n") -> DataFrame:
    """`rows` with their number within the group from 0, and the group's size. A null group is a group.

    Rows that are equal in `order` get different numbers, in any order. Uses columns `_range`, `_tie`, `_start`.
    """
    # a number per row, written down once: ranges then cut equal rows too, the same way at every reading
    held = stored(rows.withColumn("_tie", F.monotonically_increasing_id()), "to-number")
    full = [*[F.col(c) for c in group], *order, F.col("_tie")]
    held = stored(held.repartitionByRange(*full).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = held.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_size"))
    of_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # one row per range that the group touches
    starts = sizes.select(
        *group, "_range", F.sum("_size").over(of_group).alias(total),
        (F.sum("_size").over(of_group.orderBy("_range")) - F.col("_size")).alias("_start"),
    )
    both = held.withColumns({total: F.lit(None).cast("long"), "_start": F.lit(None).cast("long")}).unionByName(starts, allowMissingColumns=True)
    along = Window.partitionBy(*group, "_range").orderBy(F.col("_start").isNull(), *order, "_tie")
    counted = both.withColumns({
        name: F.sum(F.coalesce("_start", F.lit(1).cast("long"))).over(along.rowsBetween(Window.unboundedPreceding, 0)) - 1,
        total: F.first(total).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    return counted.where(F.col("_start").isNull()).drop("_tie", "_range", "_start")


def with_salt(rows: DataFrame, keys: Sequence[str], uid: str = "_uid", name: str = "_salt") -> DataFrame:
    """`rows` with a number that tells rows of equal keys apart: 0 where the keys occur once, else a hash of `uid`, a number per
    row that is written down. What is hashed together with it depends on content alone but for repeated rows, which are alike."""
    same = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)])
    met = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]
    both = rows.join(same.withColumn("_many", F.lit(True)), met, "left")
    return both.withColumn(name, F.when(F.col("_many"), F.xxhash64(uid)).otherwise(F.lit(0).cast("long"))).select(*rows.columns, name)
