"""Device health checks.

`checks` rows: `(site_id, name, entity_id, min_value, max_value, expected_state, severity, message, when_entity,
when_state, when_for_minutes, sustain_minutes, sustain_samples)`. `states` rows are current entity states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermofleet.functions.timekeys import add_seconds, seconds_between
from thermofleet.operators.asof import asof
from thermofleet.sources.states import GONE


def outside(value: Column, min_value: Column, max_value: Column) -> Column:
    """Touching a threshold already violates it; a missing threshold never does."""
    return F.coalesce(value <= min_value, F.lit(False)) | F.coalesce(value >= max_value, F.lit(False))


def precondition_met(checks: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """Checks whose condition holds: the other entity is in the state, and has been for long enough."""
    other = states.select(
        "site_id", F.col("entity_id").alias("when_entity"), F.col("state").alias("__when"),
        F.col("last_changed").alias("__since"),
    )
    joined = checks.join(other, ["site_id", "when_entity"], "left")
    needed = F.coalesce(F.col("when_for_minutes"), F.lit(0)) * 60
    dwelt = (needed <= 0) | (seconds_between(now, F.col("__since")) >= needed)
    met = F.col("when_entity").isNull() | ((F.col("__when") == F.col("when_state")) & F.coalesce(dwelt, F.lit(False)))
    return joined.filter(met).select(*checks.columns)


def sustained_counts(checks: DataFrame, history: DataFrame, now: Column) -> DataFrame:
    """Violating one-minute samples (at :30) in each check's window, the state being held between changes."""
    started = checks.filter(F.col("sustain_minutes") > 0).withColumn(
        "__start", add_seconds(now, -F.col("sustain_minutes") * 60)
    )
    minutes = F.sequence(F.lit(0), F.col("sustain_minutes").cast("int") - 1)
    samples = started.withColumn("__i", F.explode(minutes)).withColumn(
        "sample_ts", add_seconds(F.col("__start"), F.col("__i") * 60 + 30)
    ).select("site_id", "entity_id", "name", "min_value", "max_value", "sample_ts")
    values = history.filter(~F.col("state").isin(GONE)).select(
        "site_id", "entity_id", "changed_at", F.col("state").try_cast("double").alias("number")
    ).filter(F.col("number").isNotNull())
    seen = asof(samples, values, ["site_id", "entity_id"], ["number"], left_ts="sample_ts", right_ts="changed_at",
                prefix="s_")
    return seen.groupBy("site_id", "name").agg(
        F.count_if(outside(F.col("s_number"), F.col("min_value"), F.col("max_value"))).alias("n_violating")
    )


def health_alerts(checks: DataFrame, states: DataFrame, now: Column, history: DataFrame | None = None) -> DataFrame:
    """Alerts of all checks whose precondition holds.

    An unavailable entity warns; an expected state must match; otherwise the number must lie strictly inside
    its limits, and where a sustain window is set, enough samples of it must violate too.
    """
    active = precondition_met(checks, states, now)
    joined = active.join(states.select("site_id", "entity_id", "state"), ["site_id", "entity_id"])
    if history is not None:
        joined = joined.join(sustained_counts(active, history, now), ["site_id", "name"], "left")
    else:
        joined = joined.withColumn("n_violating", F.lit(None).cast("bigint"))
    number = F.col("state").try_cast("double")
    held = (
        (F.coalesce("sustain_minutes", F.lit(0)) <= 0)
        | (F.coalesce("sustain_samples", F.lit(0)) <= 0)
        | (F.coalesce("n_violating", F.lit(0)) >= F.col("sustain_samples"))
    )
    gone = F.col("state").isin(GONE)
    fault = F.when(F.col("expected_state").isNotNull(), F.col("state") != F.col("expected_state")).otherwise(
        outside(number, F.col("min_value"), F.col("max_value")) & held
    )
    kind = F.when(gone, "unavailable").when(fault, "fault")
    said = F.coalesce(F.when(F.col("message") != "", F.col("message")), F.concat_ws(" ", "entity_id", "state"))
    return joined.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        "site_id", "name", F.concat_ws("_", "name", "kind").alias("key"), "entity_id", "state", "kind",
        F.when(F.col("kind") == "unavailable", "warning").otherwise(F.coalesce("severity", F.lit("warning"))).alias("severity"),
        F.when(F.col("kind") == "unavailable", F.concat_ws(" ", "entity_id", "state")).otherwise(said).alias("message"),
    )


def heat_wanted_but_off(decisions: DataFrame, effectors: DataFrame, actions: DataFrame) -> DataFrame:
    """Manual effectors a decision turned on whose device reports `off`.

    `decisions` has `(site_id, effector, mode)`, `actions` `(site_id, effector, action)`.
    """
    manual = effectors.filter(F.col("mode_control") == "manual").select("site_id", F.col("name").alias("effector"))
    wanted = decisions.filter(F.col("mode") != "off").join(manual, ["site_id", "effector"], "left_semi")
    return wanted.join(actions.filter(F.col("action") == "off"), ["site_id", "effector"]).select(
        "site_id", "effector", F.concat("effector", F.lit("_off")).alias("key"), F.lit("critical").alias("severity")
    )


def freshness(status: DataFrame, now: Column, stale_minutes: float = 15.0, inclusive: bool = False) -> DataFrame:
    """Age of each site's newest reading; control stops past 15 minutes, health checks warn from 10."""
    age = seconds_between(now, F.col("latest_ts")) / 60.0
    stale = age >= stale_minutes if inclusive else age > stale_minutes
    return status.withColumn("age_minutes", age).withColumn("stale", stale)


def ineligible_effectors(effectors: DataFrame, states: DataFrame, gate_states: DataFrame) -> DataFrame:
    """Manual effectors that would ignore a set-point: their mode is off, or their gate device is not there.

    `states` `(site_id, entity_id, state)`; `gate_states` `(site_id, state_device, state)`.
    """
    manual = effectors.filter(F.col("mode_control") == "manual")
    own = states.select("site_id", "entity_id", F.col("state").alias("__mode"))
    gate = gate_states.select("site_id", "state_device", F.col("state").alias("__gate"))
    joined = manual.join(own, ["site_id", "entity_id"], "left").join(gate, ["site_id", "state_device"], "left")
    reason = F.when(F.col("__mode") == "off", "hvac_mode is off").when(
        F.col("state_device").isNotNull() & (F.col("__gate").isNull() | F.col("__gate").isin(GONE)),
        F.concat(F.col("state_device"), F.lit(" is "), F.coalesce("__gate", F.lit("unreachable"))),
    )
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(
        "site_id", F.col("name").alias("effector"), "reason"
    )
