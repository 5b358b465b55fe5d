"""Did somebody change a device since it was last set?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermofleet.functions.timekeys import seconds_between


def classify_devices(desired: DataFrame, observed: DataFrame, applied: DataFrame, now: Column, *,
                     tolerance: float = 0.5, stale_seconds: int = 1_800, force: bool = False) -> DataFrame:
    """`ineligible`, `already_correct`, `override` or `applied` for every device.

    All three inputs are keyed `(site_id, device)`: `desired` `(control_type, mode, target)`, `observed`
    `(mode, target)`, `applied` `(mode, target, at)`. What was applied more than 30 minutes ago is forgotten.
    Trajectory devices are compared by target, the others by mode (regulating ones also by target).
    """
    keys = ["site_id", "device"]
    seen = observed.select(*keys, F.col("mode").alias("seen_mode"), F.col("target").alias("seen_target"))
    last = applied.filter(seconds_between(now, F.col("at")) <= stale_seconds).select(
        *keys, F.col("mode").alias("last_mode"), F.col("target").alias("last_target")
    )
    joined = desired.join(seen, keys, "left").join(last, keys, "left")
    trajectory = F.col("control_type") == "trajectory"
    regulating = F.col("control_type") == "regulating"
    no = F.lit(False)
    near = F.coalesce(F.abs(F.col("seen_target") - F.col("target")) < tolerance, no)
    same_mode = F.coalesce(F.col("seen_mode") == F.col("mode"), no)
    correct = (
        F.when(trajectory, near)
        .when(regulating, same_mode & ((F.col("mode") == "off") | near))
        .otherwise(same_mode)
    )
    moved = F.when(
        trajectory, F.coalesce(F.abs(F.col("seen_target") - F.col("last_target")) > tolerance, no)
    ).otherwise(F.col("last_mode").isNotNull() & ~F.col("seen_mode").eqNullSafe(F.col("last_mode")))
    missing = F.when(trajectory, F.col("target").isNull()).otherwise(F.col("mode").isNull())
    result = (
        F.when(missing, "ineligible")
        .when(correct, "already_correct")
        .when(moved & F.lit(not force), "override")
        .otherwise("applied")
    )
    return joined.withColumn("result", result)


def next_applied(classified: DataFrame, applied: DataFrame, now: Column) -> DataFrame:
    """The last-applied table after a run: devices set now replace their old row."""
    fresh = classified.filter(F.col("result") == "applied").select("site_id", "device", "mode", "target", now.alias("at"))
    kept = applied.join(fresh.select("site_id", "device"), ["site_id", "device"], "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def result_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("site_id", "result").agg(F.count(F.lit(1)).alias("n"))
