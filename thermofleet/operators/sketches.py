"""Statistics that merge: distinct counts and quantiles of a site's day, kept as sketches and added up for any span of days.

A sketch has a fixed size whatever the day's row count, so a month of a fleet is answered from sites times days small rows. The
numbers are estimates: distinct counts within about 1.04 / sqrt(2 ** lg_k) (one standard error), ranks within about 2.3 / k ** 0.9.
Exact numbers come from `aggregates`. Nulls are left out of both sketches; a day without values has none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12  # distinct counts: 2 ** 12 registers, 1.6 % standard error
K = 400  # quantiles: ranks within about 1 %


def day_sketches(rows: DataFrame, by: Sequence[str], item: Column, number: Column, ts: str = "ts") -> DataFrame:
    """One row per key and day: n_rows, exact least and greatest number, and the two sketches."""
    return rows.groupBy(*by, F.to_date(ts).alias("dt")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(number).alias("least"), F.max(number).alias("greatest"),
        F.hll_sketch_agg(item, F.lit(LG_K)).alias("items"), F.kll_sketch_agg_double(number, F.lit(K)).alias("numbers"),
    )


def merged(sketches: DataFrame, by: Sequence[str], quantiles: Sequence[float] = (0.1, 0.5, 0.9), since: str | None = None, until: str | None = None) -> DataFrame:
    """Per key over the days from `since` to `until`: n_rows, n_items (about), least, greatest and the quantiles (about)."""
    if since is not None:
        sketches = sketches.filter(F.col("dt") >= F.lit(since).cast("date"))
    if until is not None:
        sketches = sketches.filter(F.col("dt") <= F.lit(until).cast("date"))
    summed = sketches.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("items")).alias("n_items"), F.min("least").alias("least"),
        F.max("greatest").alias("greatest"), F.kll_merge_agg_double("numbers").alias("__numbers"),
    )
    wanted = F.kll_sketch_get_quantile_double("__numbers", F.array(*[F.lit(float(q)) for q in quantiles]))
    return summed.withColumn("quantiles", wanted).drop("__numbers")
