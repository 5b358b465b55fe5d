"""Scores of plans: energy, additive predictions, shortlists, advice and attribution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermofleet.functions.labels import step_label
from thermofleet.operators.aggregates import median
from thermofleet.operators.lookup import MAX_PARTITIONS
from thermofleet.operators.spans import top_k
from thermofleet.plans.comfort import PLANNING_WEIGHTS, comfort_cost, row_cost, weight_of
from thermofleet.plans.options import HORIZON


def option_energy(options: DataFrame, effectors: DataFrame, current: DataFrame | None = None,
                  horizon: int = HORIZON) -> DataFrame:
    """Energy cost of each option row.

    Trajectory: cost x run / horizon. Regulating: also x how far the room is from the target relative to the
    band, at most 1, and 0.5 where that is unknown. Binary: the mode's cost x run / horizon. A missing run
    length means until the horizon. Off and unknown effectors cost nothing.
    """
    facts = effectors.select(
        "site_id", F.col("name").alias("effector"), "control_type", "energy_cost", "proportional_band",
        F.col("temp_sensor").alias("sensor"),
    )
    joined = options.join(facts, ["site_id", "effector"], "left")
    if current is not None:
        joined = joined.join(
            current.select("site_id", "sensor", F.col("temp").alias("room_temp")), ["site_id", "sensor"], "left"
        )
    else:
        joined = joined.withColumn("room_temp", F.lit(None).cast("double"))
    run = F.coalesce("duration_steps", F.lit(horizon) - F.col("delay_steps")) / float(horizon)
    flat = F.coalesce(F.try_element_at("energy_cost", F.lit("")), F.lit(0.0))
    by_mode = F.coalesce(F.try_element_at("energy_cost", F.col("mode")), F.lit(0.0))
    away = F.when(F.col("mode") == "heat", F.col("target") - F.col("room_temp")).otherwise(
        F.col("room_temp") - F.col("target")
    )
    share = F.coalesce(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), away) / F.col("proportional_band")), F.lit(0.5)
    )
    share = F.when(F.col("room_temp").isNull() | F.col("target").isNull(), 0.5).otherwise(share)
    cost = (
        F.when(F.col("mode") == "off", 0.0)
        .when(F.col("control_type") == "trajectory", flat * run)
        .when(F.col("control_type") == "regulating", flat * share * run)
        .when(F.col("control_type") == "binary", by_mode * run)
        .otherwise(0.0)
    )
    return joined.withColumn("energy_cost", cost).select(*options.columns, "energy_cost")


def plan_energy(plan_options: DataFrame, effectors: DataFrame, current: DataFrame | None = None,
                by: Sequence[str] = ("site_id", "plan_id")) -> DataFrame:
    return option_energy(plan_options, effectors, current).groupBy(*by).agg(F.sum("energy_cost").alias("energy_cost"))


CELLS = 2_000_000  # predicted temperatures and effects that one partition unfolds, at most about


def additive_predictions(plan_options: DataFrame, baseline: DataFrame, marginals: DataFrame,
                         by: Sequence[str] = ("site_id", "plan_id")) -> DataFrame:
    """Predicted temperature = baseline + sum of the chosen options' effects.

    `marginals` has `(site_id, effector, option_no, sensor, step, delta)` and may leave out zero effects.
    """
    none = F.lit(None).cast("double")
    key = ["site_id", "effector", "option_no"]
    # cells stay in arrays (a site's sensors and steps, an option's effects) until a plan's rows are together
    start = baseline.groupBy("site_id").agg(F.collect_list(F.struct("sensor", "step", "base_temp", none.alias("delta"))).alias("__cells"))
    felt = marginals.groupBy(*key).agg(F.collect_list(F.struct("sensor", "step", none.alias("base_temp"), "delta")).alias("__cells"))
    plans = plan_options.select(*by).distinct().join(start, ["site_id"]).select(*by, "__cells")
    effects = plan_options.select(*by, "effector", "option_no").join(felt, key).select(*by, "__cells")
    # a site's options with all its cells are more than what unfolds: that many partitions, not merged again at run time
    chosen = plan_options.groupBy("site_id").agg(F.count(F.lit(1)).alias("__n"))
    cells = chosen.join(start, ["site_id"]).agg(F.sum(F.col("__n") * F.size("__cells"))).first()[0] or 0
    parts = int(min(cells // CELLS + 1, MAX_PARTITIONS))
    both = plans.unionByName(effects).repartition(parts, *by).select(*by, F.explode("__cells").alias("c")).select(*by, "c.*")
    summed = both.groupBy(*by, "sensor", "step").agg(F.max("base_temp").alias("base_temp"), F.sum("delta").alias("delta"))
    return summed.filter(F.col("base_temp").isNotNull()).select(
        *by, "sensor", "step", (F.col("base_temp") + F.coalesce("delta", F.lit(0.0))).alias("temp")
    )


def plan_scores(predictions: DataFrame, energy: DataFrame, schedules: DataFrame, base_hour: Column,
                by: Sequence[str] = ("site_id", "plan_id")) -> DataFrame:
    """Comfort plus energy per plan."""
    comfort = comfort_cost(predictions, schedules, base_hour, by)
    return comfort.join(energy, list(by), "left").withColumn(
        "energy_cost", F.coalesce("energy_cost", F.lit(0.0))
    ).withColumn("total_cost", F.col("comfort_cost") + F.col("energy_cost"))


def shortlist(scores: DataFrame, k: int = 100, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """The `k` cheapest plans and the all-off plan (plan 0)."""
    return top_k(
        scores, by, [F.col("total_cost"), F.col("plan_id")], k, mandatory=F.col("plan_id") == 0
    )


def cold_rescue(scores: DataFrame, plan_options: DataFrame, current: DataFrame, bounds: DataFrame,
                emergency: DataFrame, blocked: DataFrame, margin: float = 1.0) -> DataFrame:
    """Where doing nothing wins while a room is far too cold: the cheapest plan with its rescuers on at once.

    `emergency` gives each sensor its strongest trajectory effector; blocked effectors cannot rescue.
    """
    best = scores.groupBy("site_id").agg(
        F.min_by("plan_id", F.struct("total_cost", "plan_id")).alias("best_plan")
    ).filter(F.col("best_plan") == 0)
    cold = (
        current.join(bounds.select("site_id", "sensor", "acc_lo"), ["site_id", "sensor"])
        .filter(F.col("temp") < F.col("acc_lo") - margin)
        .join(best.select("site_id"), ["site_id"], "left_semi")
        .join(emergency.select("site_id", "sensor", "effector"), ["site_id", "sensor"])
        .select("site_id", "effector")
        .distinct()
        .join(blocked.select("site_id", "effector"), ["site_id", "effector"], "left_anti")
    )
    needed = cold.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_needed"))
    running = plan_options.filter((F.col("mode") != "off") & (F.col("delay_steps") == 0)).join(
        cold, ["site_id", "effector"], "left_semi"
    )
    fit = (
        running.groupBy("site_id", "plan_id")
        .agg(F.count(F.lit(1)).alias("n_on"))
        .join(needed, ["site_id"])
        .filter(F.col("n_on") == F.col("n_needed"))
    )
    return scores.join(fit.select("site_id", "plan_id"), ["site_id", "plan_id"], "left_semi").groupBy("site_id").agg(
        F.min_by("plan_id", F.struct("total_cost", "plan_id")).alias("plan_id"), F.min("total_cost").alias("total_cost")
    )


def baseline_plan(advised: DataFrame, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """Cheapest plan in which every device holds. `advised` has `(…, plan_id, device, action, total_cost)`."""
    per_plan = advised.groupBy(*by, "plan_id", "total_cost").agg(
        F.bool_and(F.coalesce(F.col("action"), F.lit("hold")) == "hold").alias("all_hold")
    )
    return per_plan.filter("all_hold").groupBy(*by).agg(
        F.min_by("plan_id", F.struct("total_cost", "plan_id")).alias("baseline_plan"),
        F.min("total_cost").alias("baseline_cost"),
    )


def device_opportunities(advised: DataFrame, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """Per device the best plan that moves it against the best that holds it (else the all-hold plan)."""
    moving, holding = F.col("action") != "hold", F.col("action") == "hold"
    rank = F.struct("total_cost", "plan_id")
    best = advised.filter(F.col("device").isNotNull()).groupBy(*by, "device").agg(
        F.min_by(F.struct("plan_id", "action", "transition_step", "return_step", "total_cost"), F.when(moving, rank)).alias("c"),
        F.min(F.when(holding, F.col("total_cost"))).alias("hold_cost"),
    )
    compared = best.filter(F.col("c").isNotNull()).join(baseline_plan(advised, by), list(by), "left")
    without = F.coalesce("hold_cost", "baseline_cost")
    return compared.filter(without.isNotNull()).select(
        *by, "device", "c.plan_id", "c.action", "c.transition_step", "c.return_step",
        (F.col("c.total_cost") - without).alias("cost_delta"),
    )


def opportunities(found: DataFrame) -> DataFrame:
    """Moves that pay, in minutes; order by `cost_delta` when presenting them."""
    return found.filter(F.col("cost_delta") < 0).select(
        *[c for c in found.columns if c not in ("transition_step", "return_step", "cost_delta")],
        (F.col("transition_step") * 5).alias("in_minutes"),
        ((F.col("return_step") - F.col("transition_step")) * 5).alias("duration_minutes"),
        F.round("cost_delta", 4).alias("cost_delta"),
    )


def breach_override(best: DataFrame, baseline: DataFrame, breaches: DataFrame, plan_options: DataFrame) -> DataFrame:
    """The baseline instead of the best plan where holding would breach backup bounds, the baseline runs
    something and the best plan nothing."""
    active = plan_options.groupBy("site_id", "plan_id").agg(F.bool_or(F.col("mode") != "off").alias("runs"))
    breached = breaches.select("site_id").distinct().withColumn("breached", F.lit(True))
    joined = (
        best.select("site_id", F.col("plan_id").alias("best_plan"))
        .join(baseline.select("site_id", "baseline_plan"), ["site_id"], "left")
        .join(breached, ["site_id"], "left")
        .join(active.select("site_id", F.col("plan_id").alias("best_plan"), F.col("runs").alias("best_runs")),
              ["site_id", "best_plan"], "left")
        .join(active.select("site_id", F.col("plan_id").alias("baseline_plan"), F.col("runs").alias("baseline_runs")),
              ["site_id", "baseline_plan"], "left")
    )
    off = F.lit(False)
    override = (
        F.coalesce("breached", off) & F.coalesce("baseline_runs", off) & ~F.coalesce("best_runs", off)
    )
    return joined.select(
        "site_id", F.when(override, F.col("baseline_plan")).otherwise(F.col("best_plan")).alias("plan_id"),
        override.alias("overridden"),
    )


def attribution(chosen: DataFrame, without: DataFrame, schedules: DataFrame, base_hour: Column,
                weights: Mapping[int, float] = PLANNING_WEIGHTS) -> DataFrame:
    """What each running device contributes: the plan against the same plan without it.

    `chosen` has `(site_id, sensor, step, temp)` and `without` adds `device`. Gives the total saving, the sensor
    with the largest saving either way and the horizon with the largest temperature difference on it.
    """
    from thermofleet.plans.comfort import bounds_at

    base = chosen.filter(F.col("step").isin(list(weights))).withColumnRenamed("temp", "plan_temp")
    both = without.filter(F.col("step").isin(list(weights))).join(base, ["site_id", "sensor", "step"])
    bounded = bounds_at(both, schedules, base_hour, F.col("step"), how="left")
    weight = weight_of(F.col("step"), weights)
    saving = F.coalesce(row_cost(F.col("temp"), weight) - row_cost(F.col("plan_temp"), weight), F.lit(0.0))
    gap = F.abs(F.col("plan_temp") - F.col("temp"))
    per_sensor = bounded.groupBy("site_id", "device", "sensor").agg(
        F.sum(saving).alias("saving"),
        F.max_by(F.struct("step", "plan_temp", F.col("temp").alias("without_temp"), gap.alias("gap")),
                 F.struct(gap, -F.col("step"))).alias("widest"),
    )
    best = F.struct(F.abs("saving"), F.col("sensor"))
    out = per_sensor.groupBy("site_id", "device").agg(
        F.sum("saving").alias("total_saving"),
        F.max_by(F.struct("sensor", "saving", "widest"), best).alias("top"),
    )
    effect = (
        F.when(F.abs("total_saving") < 0.1, "none").when(F.col("top.widest.gap") < 0.05, "diffuse").otherwise("local")
    )
    return out.select(
        "site_id", "device", "total_saving", F.col("top.sensor").alias("sensor"), F.col("top.saving").alias("sensor_saving"),
        step_label(F.col("top.widest.step")).alias("horizon"), F.col("top.widest.plan_temp").alias("plan_temp"),
        F.col("top.widest.without_temp").alias("without_temp"), effect.alias("effect"),
    )


def normalized_benefit(pairs: DataFrame, n_schedules: Column, weights: Mapping[int, float] = PLANNING_WEIGHTS) -> DataFrame:
    """Benefit per schedule and horizon weight plus the energy saving; above 0.3 tracked, above 1.5 announced."""
    norm = n_schedules * F.lit(sum(weights.values()))
    benefit = (F.col("old_comfort") - F.col("new_comfort")) / norm + (F.col("old_energy") - F.col("new_energy"))
    return pairs.withColumn("benefit", benefit).withColumns(
        {"track": F.col("benefit") > 0.3, "announce": F.col("benefit") > 1.5}
    )


def prediction_envelope(predictions: DataFrame, current: DataFrame, by: Sequence[str] = ("site_id",),
                        lowest: float = 35.0, highest: float = 100.0, per_hour: float = 8.0,
                        spread: float = 30.0) -> DataFrame:
    """Implausible predictions over all plans, one row per finding.

    Range findings are errors; the median moving faster than `per_hour` and a wide spread are warnings.
    """
    keys = [*by, "sensor", "step"]
    stats = predictions.filter(F.col("temp").isNotNull()).groupBy(*keys).agg(
        F.min("temp").alias("pred_min"), F.max("temp").alias("pred_max"),
        F.count_if(F.col("temp") > highest).alias("n_high"), F.count_if(F.col("temp") < lowest).alias("n_low"),
        F.count(F.lit(1)).alias("n_plans"),
    )
    middles = median(predictions, keys, "temp", "pred_median")
    joined = stats.join(middles, keys).join(
        current.select(*by, "sensor", F.col("temp").alias("current")), [*by, "sensor"]
    )
    hours = F.col("step") / 12.0

    def finding(when: Column, check: str, severity: str, value: Column) -> Column:
        return F.when(when, F.struct(
            F.lit(check).alias("check"), F.lit(severity).alias("severity"), value.cast("double").alias("value")))

    findings = F.array_compact(F.array(
        finding(F.col("pred_max") > highest, "prediction_range_high", "error", F.col("pred_max")),
        finding(F.col("pred_min") < lowest, "prediction_range_low", "error", F.col("pred_min")),
        finding(F.abs(F.col("pred_median") - F.col("current")) > per_hour * hours, "prediction_rate", "warning",
                F.col("pred_median")),
        finding(F.col("pred_max") - F.col("pred_min") > spread, "prediction_spread", "warning",
                F.col("pred_max") - F.col("pred_min")),
    ))
    return joined.withColumn("f", F.explode(findings)).select(*keys, "f.check", "f.severity", "f.value", "n_high", "n_low", "n_plans")


def decision_sanity(predictions: DataFrame, current: DataFrame, by: Sequence[str] = ("site_id", "ts"),
                    max_first_hour: float = 5.0, lowest: float = 35.0, highest: float = 100.0,
                    per_hour: float = 8.0) -> DataFrame:
    """Predictions of a decision that should not be acted on. `predictions` has `(…, sensor, horizon, predicted)`."""
    joined = predictions.filter(F.col("predicted").isNotNull()).join(
        current.select(*by, "sensor", F.col("temp").alias("current")), [*by, "sensor"]
    )
    hours = F.regexp_replace("horizon", "h$", "").try_cast("double")
    change = F.abs(F.col("predicted") - F.col("current"))
    rules = F.array_compact(F.array(
        F.when((F.col("horizon") == "1h") & (change > max_first_hour), "first_hour_change"),
        F.when(F.col("predicted") > highest, "above_ceiling").when(F.col("predicted") < lowest, "below_floor"),
        F.when(change > per_hour * hours, "rate"),
    ))
    return joined.withColumn("rule", F.explode(rules))


def rank_costs(scores: DataFrame, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """The cheapest plan per site."""
    window = Window.partitionBy(*by).orderBy("total_cost", "plan_id")
    return scores.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") == 1).drop("rank")
