"""Comfort, capacity and control reports over the decision log, and the status board."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermofleet.functions.bands import band_status
from thermofleet.functions.labels import effector_suffix, sensor_label
from thermofleet.functions.timekeys import local_hour
from thermofleet.operators.aggregates import best_gain, capacity_stats, comfort_stats
from thermofleet.operators.asof import asof, forecast_at_horizons, nearest
from thermofleet.operators.lookup import hourly_schedule
from thermofleet.operators.reshape import flatten_map2
from thermofleet.plans.comfort import apply_profile, radiant_offset, shift_bounds
from thermofleet.session import cut_lineage


def bounds_rows(decisions: DataFrame) -> DataFrame:
    """`(site_id, ts, label, lo, hi, pref_lo, pref_hi)` of every decision; old rows have min and max only."""
    rows = decisions.select("site_id", "ts", F.explode("comfort_bounds").alias("label", "b"))

    def of(key: str) -> Column:
        return F.try_element_at("b", F.lit(key))

    return rows.select(
        "site_id", "ts", "label", of("min").alias("lo"), of("max").alias("hi"),
        F.coalesce(of("preferred_lo"), of("min")).alias("pref_lo"),
        F.coalesce(of("preferred_hi"), of("max")).alias("pref_hi"),
    )


def historic_band(temps: DataFrame, bounds: DataFrame, schedules: DataFrame, zone: Column | str = "UTC") -> DataFrame:
    """Band that applied at each reading: of the last decision naming the label, before the first one the
    schedule at the local hour. `temps` has `(site_id, label, ts, temp)`."""
    found = asof(temps, bounds, ["site_id", "label"], ["lo", "hi", "pref_lo", "pref_hi"], prefix="d_")
    plan = hourly_schedule(schedules, ("site_id", "label")).select(
        "site_id", "label", "hour", F.col("acc_lo").alias("s_lo"), F.col("acc_hi").alias("s_hi"),
        F.col("pref_lo").alias("s_pref_lo"), F.col("pref_hi").alias("s_pref_hi"),
    )
    joined = found.withColumn("hour", local_hour(F.col("ts"), zone)).join(plan, ["site_id", "label", "hour"], "left")
    decided = F.col("d_ts").isNotNull()
    picks = {c: F.when(decided, F.col(f"d_{c}")).otherwise(F.col(f"s_{c}")) for c in ("lo", "hi", "pref_lo", "pref_hi")}
    return joined.select(*temps.columns, *[v.alias(k) for k, v in picks.items()])


def dedicated_effectors(gains: DataFrame, effectors: DataFrame, constraints: DataFrame) -> DataFrame:
    """Effectors that belong to a label: its strongest trajectory one and regulating or binary namesakes.

    `constraints` has `(site_id, sensor, label)`.
    """
    best = best_gain(gains, effectors).select("site_id", "sensor", "effector")
    first = constraints.join(best, ["site_id", "sensor"]).select("site_id", "label", "effector")
    named = effectors.filter(F.col("control_type").isin("regulating", "binary")).select(
        "site_id", effector_suffix(F.col("name")).alias("label"), F.col("name").alias("effector")
    )
    namesakes = named.join(constraints.select("site_id", "label").distinct(), ["site_id", "label"], "left_semi")
    return first.unionByName(namesakes).distinct()


def activity_level(mode: Column) -> Column:
    """Share of full power a mode means: off 0, low half, everything else full."""
    return F.when(mode == "off", 0.0).when(mode == "low", 0.5).otherwise(1.0)


def capacity_rows(decisions: DataFrame, dedicated: DataFrame, constraints: DataFrame) -> DataFrame:
    """Per decision and label: signed violation and whether every dedicated effector was flat out.

    A label without dedicated effectors counts as at capacity. Temperatures are keyed by sensor, bounds by
    label, so the two meet through the constraint table.
    """
    temps = decisions.select("site_id", "ts", F.explode("current_temps").alias("sensor", "temp")).join(
        constraints, ["site_id", "sensor"]
    )
    rows = temps.join(bounds_rows(decisions), ["site_id", "ts", "label"])
    doing = decisions.select("site_id", "ts", F.explode("effector_decisions").alias("e")).select(
        "site_id", "ts", F.col("e.name").alias("effector"), activity_level(F.col("e.mode")).alias("level")
    )
    owned = rows.select("site_id", "ts", "label").join(dedicated, ["site_id", "label"]).join(
        doing, ["site_id", "ts", "effector"], "left"
    )
    full = owned.groupBy("site_id", "ts", "label").agg(
        F.bool_and(F.coalesce("level", F.lit(0.0)) >= 0.99).alias("at_capacity")
    )
    t, lo, hi = F.col("temp"), F.col("lo"), F.col("hi")
    violation = F.when(t < lo, lo - t).when(t > hi, hi - t).otherwise(0.0)
    return rows.join(full, ["site_id", "ts", "label"], "left").select(
        "site_id", "ts", "label", "temp", "lo", "hi", violation.alias("violation"),
        F.coalesce("at_capacity", F.lit(True)).alias("at_capacity"),
    )


def authority_rows(decisions: DataFrame, dedicated: DataFrame) -> DataFrame:
    """Control authority of every decision per label: 0 when not live or all dedicated effectors are blocked,
    0.5 when some are, 1 otherwise."""
    owned = dedicated.groupBy("site_id", "label").agg(F.collect_set("effector").alias("effectors"))
    joined = decisions.select(
        "site_id", "ts", F.coalesce("live", F.lit(False)).alias("live"),
        F.coalesce(F.map_keys("blocked"), F.array().cast("array<string>")).alias("stopped"),
    ).join(owned, ["site_id"])
    n = F.size(F.array_intersect("effectors", "stopped"))
    level = (
        F.when(~F.col("live") | (n == F.size("effectors")), 0.0).when(n > 0, 0.5).otherwise(1.0)
    )
    return joined.select("site_id", "label", "ts", level.alias("authority"))


def control_authority(temps: DataFrame, authority: DataFrame, stale_seconds: int = 1_200) -> DataFrame:
    """Authority at each reading, valid for 20 minutes after its decision; NULL when there is none."""
    out = asof(temps, authority, ["site_id", "label"], ["authority"], tolerance_seconds=stale_seconds, prefix="d_")
    return out.withColumnRenamed("d_authority", "authority").drop("d_ts")


def comfort_report(readings: DataFrame, decisions: DataFrame, schedules: DataFrame, dedicated: DataFrame,
                   constraints: DataFrame, zone: str = "UTC", count_unknown: bool = False) -> DataFrame:
    """Per site and label: band shares, violations by capacity and share of time under full control.

    `count_unknown` also divides by readings without a recent decision.
    """
    decisions = cut_lineage(decisions)  # bounds, authority and capacity all come from these rows
    temps = readings.join(constraints, (readings.site_id == constraints.site_id) & (readings.name == constraints.sensor)).select(
        readings.site_id, "label", "ts", F.when(F.col("value").try_cast("double") >= 40.0, F.col("value").try_cast("double")).alias("temp")
    )
    banded = historic_band(temps, bounds_rows(decisions), schedules, zone)
    judged = cut_lineage(control_authority(banded, authority_rows(decisions, dedicated)))
    stats = comfort_stats(judged, ["site_id", "label"])
    known = F.col("authority").isNotNull()
    full = F.when(F.col("authority") == 1.0, 100.0).otherwise(0.0)
    share = F.when(F.count_if(known) > 0, F.avg(full if count_unknown else F.when(known, full)))
    control = judged.groupBy("site_id", "label").agg(share.alias("pct_controlled"))
    capacity = capacity_stats(capacity_rows(decisions, dedicated, constraints), ["site_id", "label"])
    counts = ["cold_total", "cold_capacity", "cold_control", "hot_total", "hot_capacity", "hot_control"]
    return (
        stats.join(control, ["site_id", "label"], "left")
        .join(capacity, ["site_id", "label"], "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    )


def site_summary(report: DataFrame, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """Label rows rolled up to one row per site."""
    return report.groupBy(*by).agg(
        F.avg("pct_in_band").alias("pct_in_band"), F.avg("avg_violation").alias("avg_violation"),
        F.avg("pct_controlled").alias("pct_controlled"),
        *[F.sum(c).alias(c) for c in ("cold_total", "cold_capacity", "cold_control", "hot_total", "hot_capacity", "hot_control")],
        F.count(F.lit(1)).alias("n_labels"),
    )


def prediction_errors(decisions: DataFrame) -> DataFrame:
    """Outcome rows out of backfilled decisions."""
    rows = decisions.filter(F.col("outcomes").isNotNull()).select("site_id", F.col("ts").alias("decision_ts"), "outcomes")
    flat = flatten_map2(rows, "outcomes", "sensor", "horizon", "o")
    return flat.select(
        "site_id", "decision_ts", "sensor", sensor_label(F.col("sensor")).alias("label"), "horizon", "o.predicted",
        "o.actual", "o.error",
    ).filter(F.col("predicted").isNotNull() & F.col("actual").isNotNull())


def logged_vs_recomputed(logged: DataFrame, recomputed: DataFrame, tolerance_seconds: int = 600) -> DataFrame:
    """Difference of comfort cost at the nearest logged decision."""
    out = nearest(recomputed, logged, ["site_id"], ["comfort_cost"], tolerance_seconds=tolerance_seconds, prefix="logged_")
    return out.withColumn("difference", F.col("comfort_cost") - F.col("logged_comfort_cost"))


def board_sections(latest: DataFrame, environment: DataFrame, refs: DataFrame, forecast: DataFrame,
                   hours: tuple[int, ...] = (1, 2, 4, 6, 12)) -> DataFrame:
    """The board beside its temperatures: rows `(site_id, section, name, value, state)`.

    `environment` lists `(site_id, name)` of openings and shades: their latest value and whether they are active.
    `refs` is `(site_id, ts)`, the time of the board: the closest forecast entry at each horizon and its condition.
    """
    states = latest.join(environment.select("site_id", "name"), ["site_id", "name"], "left_semi").select(
        "site_id", F.lit("environment").alias("section"), "name", F.col("value").try_cast("double").alias("value"),
        F.when(F.col("active"), "active").otherwise("default").alias("state"),
    )
    ahead = forecast_at_horizons(refs, forecast, hours, values=("temperature", "condition")).select(
        "site_id", F.lit("forecast").alias("section"), F.col("horizon").alias("name"),
        F.col("forecast_temperature").alias("value"), F.col("forecast_condition").alias("state"),
    )
    return states.unionByName(ahead)


def status_board(latest: DataFrame, schedules: DataFrame, profile: DataFrame, weather: DataFrame, solar_gains: DataFrame,
                 zones: DataFrame, alpha: float = 0.05, reference: float = 50.0, max_offset: float = 2.0,
                 solar_response: float = 1.0) -> DataFrame:
    """One row per site and sensor: latest value, the bounds in force now and where the value stands.

    `weather` has `(site_id, outdoor, sun, fraction)`, `zones` `(site_id, zone, now_ts)`, `latest` `(site_id,
    name, value, ts)`.
    """
    now = zones.select("site_id", local_hour(F.col("now_ts"), F.col("zone")).alias("hour"))
    table = hourly_schedule(apply_profile(schedules, profile)).drop("seq", "start_hour", "end_hour")
    rows = (
        latest.withColumnRenamed("name", "sensor")
        .withColumn("temp", F.col("value").try_cast("double"))
        .join(now, ["site_id"])
        .join(table, ["site_id", "sensor", "hour"])
        .join(weather, ["site_id"], "left")
        .join(solar_gains.select("site_id", "sensor", "gain"), ["site_id", "sensor"], "left")
    )
    offset = F.coalesce(
        radiant_offset(F.col("outdoor"), F.col("gain"), F.coalesce("sun", F.lit(0.0)), F.coalesce("fraction", F.lit(0.0)),
                       F.col("weight"), alpha, reference, max_offset, solar_response),
        F.lit(0.0),
    )
    shifted = shift_bounds(rows, offset)
    return shifted.select(
        "site_id", "sensor", "label", "ts", "temp", "hour", "acc_lo", "acc_hi", "pref_lo", "pref_hi",
        band_status(F.col("temp"), F.col("acc_lo"), F.col("acc_hi"), F.col("pref_lo"), F.col("pref_hi")).alias("status"),
    )
