"""Dimensions from parsed configuration mappings.

The mapping is configuration (already parsed, one document per site), so these tables are built on the driver;
they are left to Spark to broadcast or not.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermofleet.functions.labels import sensor_label

SCHEDULE_RAW = (
    "site_id bigint, sensor string, seq int, start_hour int, end_hour int, preferred array<double>, "
    "acceptable array<double>, min double, max double, backup array<double>, cold_penalty double, "
    "hot_penalty double, weight double"
)
EFFECTORS = (
    "site_id bigint, name string, entity_id string, control_type string, mode_control string, "
    "supported_modes array<string>, max_lag_minutes int, energy_cost map<string,double>, "
    "depends_on array<string>, proportional_band double, hold_start int, hold_end int, "
    "temp_sensor string, state_device string"
)


def _pair(value: Any) -> list[float] | None:
    if value is None:
        return None
    return [float(value[0]), float(value[1])] if isinstance(value, (list, tuple)) else [float(value), float(value)]


def schedule_table(raw: DataFrame, backup_margin: float = 3.0) -> DataFrame:
    """Three tiers per entry: acceptable else min/max, backup else acceptable +- margin, preferred else midpoint."""
    lo = F.coalesce(F.try_element_at("acceptable", F.lit(1)), F.col("min"))
    hi = F.coalesce(F.try_element_at("acceptable", F.lit(2)), F.col("max"))
    middle = (lo + hi) / 2.0
    return raw.select(
        "site_id", "sensor", sensor_label(F.col("sensor")).alias("label"), "seq", "start_hour", "end_hour",
        F.coalesce(F.try_element_at("preferred", F.lit(1)), middle).alias("pref_lo"),
        F.coalesce(F.try_element_at("preferred", F.lit(2)), middle).alias("pref_hi"),
        lo.alias("acc_lo"),
        hi.alias("acc_hi"),
        F.coalesce(F.try_element_at("backup", F.lit(1)), lo - backup_margin).alias("backup_lo"),
        F.coalesce(F.try_element_at("backup", F.lit(2)), hi + backup_margin).alias("backup_hi"),
        F.coalesce("cold_penalty", F.lit(2.0)).alias("cold_penalty"),
        F.coalesce("hot_penalty", F.lit(1.0)).alias("hot_penalty"),
        F.coalesce("weight", F.lit(1.0)).alias("weight"),
    )


def load_schedules(spark: SparkSession, site_id: int, schedules: Iterable[Mapping[str, Any]],
                   backup_margin: float = 3.0) -> DataFrame:
    rows = []
    for schedule in schedules:
        for seq, entry in enumerate(schedule["schedule"]):
            rows.append(
                (
                    site_id, schedule["sensor"], seq, int(entry["hours"][0]), int(entry["hours"][1]),
                    _pair(entry.get("preferred")), _pair(entry.get("acceptable")),
                    entry.get("min") and float(entry["min"]), entry.get("max") and float(entry["max"]),
                    _pair(entry.get("backup")), entry.get("cold_penalty") and float(entry["cold_penalty"]),
                    entry.get("hot_penalty") and float(entry["hot_penalty"]), float(schedule.get("mrt_weight", 1.0)),
                )
            )
    return schedule_table(spark.createDataFrame(rows, SCHEDULE_RAW), backup_margin)


EFFECTORS_RAW = EFFECTORS.replace("energy_cost map<string,double>", "energy_cost string").replace("hold_start int, hold_end int", "mode_hold_window array<int>")


def effector_table(raw: DataFrame) -> DataFrame:
    """Effectors with defaults. Energy cost is JSON text, one number or one per mode; a plain number is stored under the empty
    mode name, and without cost it is zero."""
    plain = F.create_map(F.lit(""), F.coalesce(F.col("energy_cost").try_cast("double"), F.lit(0.0)))
    cost = F.when(F.col("energy_cost").startswith("{"), F.from_json("energy_cost", "map<string,double>")).otherwise(plain)
    none = F.array().cast("array<string>")
    return raw.select(
        "site_id", "name", "entity_id", "control_type", F.coalesce("mode_control", F.lit("automatic")).alias("mode_control"),
        F.coalesce("supported_modes", none).alias("supported_modes"), F.coalesce("max_lag_minutes", F.lit(90)).alias("max_lag_minutes"),
        cost.alias("energy_cost"), F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("proportional_band", F.lit(1.0)).alias("proportional_band"),
        F.try_element_at("mode_hold_window", F.lit(1)).alias("hold_start"), F.try_element_at("mode_hold_window", F.lit(2)).alias("hold_end"), "temp_sensor", "state_device",
    )


def encoding_table(raw: DataFrame) -> DataFrame:
    """Rows `(owner, label, code)` of landed documents `(owner, labels map<string,double>)`; a label told twice keeps its greatest code."""
    rows = raw.select("owner", F.explode("labels").alias("label", "code"))
    return rows.groupBy("owner", "label").agg(F.max("code").alias("code"))


def column_catalog(effectors: DataFrame, sensors: DataFrame) -> DataFrame:
    """Columns of a site's wide table with their storage type: four per effector, one per sensor (`site_id, name`)."""
    kinds = F.create_map(*[F.lit(x) for kind, of in (("REAL", ("_temp", "_target")), ("TEXT", ("_mode", "_action"))) for suffix in of for x in (suffix, kind)])
    own = effectors.select("site_id", "name", F.explode(kinds).alias("suffix", "storage")).select("site_id", F.concat("name", "suffix").alias("column_name"), "storage")
    return own.unionByName(sensors.select("site_id", F.col("name").alias("column_name"), F.lit("REAL").alias("storage"))).distinct()
