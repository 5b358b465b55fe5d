"""What each effector and environment device could do, and every plan built from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermofleet.functions.timekeys import hour_in_window
from thermofleet.operators.lookup import PAGE, combination_pages, combination_table, drop_keys, numbered_choices, option_index, spread_pages, with_effect

# Start delays, run lengths and return times in 5-minute steps; the horizon is six hours.
DELAYS = (0, 12, 24)
DURATIONS = (12, 24, 72)
RETURN_STEPS = (0, 12, 24, 36)
HORIZON = 72

OPTION = ["mode", "target", "delay_steps", "duration_steps"]


def timing_grid(delays: Sequence[int] = DELAYS, durations: Sequence[int] = DURATIONS, horizon: int = HORIZON) -> Column:
    """Array of distinct (delay, duration) pairs; a run is cut at the horizon, which creates duplicates."""
    pairs = sorted({(d, min(run, horizon - d)) for d in delays if d < horizon for run in durations})
    return F.array(*[F.struct(F.lit(d).alias("delay_steps"), F.lit(n).alias("duration_steps")) for d, n in pairs])


def _off(effectors: DataFrame) -> DataFrame:
    return effectors.select(
        "site_id", F.col("name").alias("effector"), F.lit("off").alias("mode"), F.lit(None).cast("double").alias("target"),
        F.lit(0).alias("delay_steps"), F.lit(None).cast("int").alias("duration_steps"),
    )


def timed_options(effectors: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Trajectory and binary effectors without parents: off, and each mode at each timing.

    Blocked or ineligible trajectory effectors (`site_id, effector`) keep off only.
    """
    free = effectors.filter(
        F.col("control_type").isin("trajectory", "binary") & (F.coalesce(F.size("depends_on"), F.lit(0)) <= 0)
    )
    trajectory = F.col("control_type") == "trajectory"
    modes = F.when(trajectory, F.array(F.lit("heating"))).otherwise(
        F.filter("supported_modes", lambda m: m != "off")
    )
    running = free.select(
        "site_id", F.col("name").alias("effector"), "control_type", F.explode(modes).alias("mode")
    ).withColumn("t", F.explode(timing_grid()))
    if blocked is not None:
        held = blocked.select("site_id", "effector").withColumn("control_type", F.lit("trajectory"))
        running = drop_keys(running, held, ["site_id", "effector", "control_type"])
    running = running.select(
        "site_id", "effector", "mode", F.lit(None).cast("double").alias("target"), "t.delay_steps", "t.duration_steps"
    )
    return _off(free).unionByName(running)


def blocked_effectors(effectors: DataFrame, current: DataFrame, bounds: DataFrame, default_max: float = 78.0) -> DataFrame:
    """Trajectory effectors whose own sensor is at or above its acceptable maximum now."""
    mine = effectors.filter((F.col("control_type") == "trajectory") & F.col("temp_sensor").isNotNull()).select(
        "site_id", F.col("name").alias("effector"), F.col("temp_sensor").alias("sensor")
    )
    ceiling = F.coalesce(F.col("acc_hi"), F.lit(default_max))
    joined = mine.join(current.select("site_id", "sensor", "temp"), ["site_id", "sensor"]).join(
        bounds.select("site_id", "sensor", "acc_hi"), ["site_id", "sensor"], "left"
    )
    return joined.filter(F.col("temp") >= ceiling).select("site_id", "effector", "temp", ceiling.alias("ceiling"))


def merge_targets(targets: Column, tolerance: float = 0.5) -> Column:
    """Sorted distinct targets; one within `tolerance` of the last kept is dropped (greedy, left to right).

    The array holds one target per constrained sensor of a site, so the fold is short.
    """
    empty = F.array().cast("array<double>")
    return F.aggregate(
        F.array_sort(F.array_distinct(targets)),
        empty,
        lambda kept, t: F.when(
            (F.size(kept) == 0) | (F.abs(t - F.element_at(kept, -1)) > tolerance), F.array_append(kept, t)
        ).otherwise(kept),
    )


def regulating_options(effectors: DataFrame, gains: DataFrame, bounds: DataFrame, current: DataFrame,
                       previous: DataFrame | None = None, base_hour: Column | None = None) -> DataFrame:
    """Regulating effectors: off, and each supported mode at the preferred temperatures of affected sensors.

    Heat aims at preferred lows and cool at preferred highs of every sensor with a non-zero gain. A target the
    reference sensor (strongest gain) has passed by more than the band is left out. Inside its hold window an
    effector keeps its previous mode; with no such option left it repeats the previous mode and set-point.
    """
    mine = effectors.filter(F.col("control_type") == "regulating")
    felt = gains.filter(F.col("gain_f_per_hour") != 0).select("site_id", "effector", "sensor", "gain_f_per_hour")
    aims = felt.join(bounds.select("site_id", "sensor", "pref_lo", "pref_hi"), ["site_id", "sensor"]).groupBy(
        "site_id", "effector"
    ).agg(
        merge_targets(F.collect_list(F.col("pref_lo").cast("double"))).alias("heat"),
        merge_targets(F.collect_list(F.col("pref_hi").cast("double"))).alias("cool"),
    )
    seen = felt.join(current.select("site_id", "sensor", "temp"), ["site_id", "sensor"])
    strongest = F.struct(F.abs("gain_f_per_hour"), F.col("sensor"))
    reference = seen.groupBy("site_id", "effector").agg(F.max_by("temp", strongest).alias("ref_temp"))
    own = current.select("site_id", F.col("sensor").alias("temp_sensor"), F.col("temp").alias("own_temp"))
    base = (
        mine.withColumnRenamed("name", "effector")
        .join(aims, ["site_id", "effector"])
        .join(reference, ["site_id", "effector"], "left")
        .join(own, ["site_id", "temp_sensor"], "left")
        .withColumn("ref_temp", F.coalesce("ref_temp", "own_temp"))
    )
    aimed = base.withColumn("mode", F.explode("supported_modes")).withColumn(
        "target", F.explode(F.when(F.col("mode") == "heat", F.col("heat")).when(F.col("mode") == "cool", F.col("cool")))
    )
    band = F.col("proportional_band")
    idle = (
        F.when(F.col("mode") == "heat", F.col("ref_temp") > F.col("target") + band)
        .when(F.col("mode") == "cool", F.col("ref_temp") < F.col("target") - band)
    )
    running = aimed.filter(~F.coalesce(idle, F.lit(False))).withColumn("t", F.explode(timing_grid())).select(
        "site_id", "effector", "mode", F.round("target", 1).alias("target"), "t.delay_steps", "t.duration_steps"
    ).distinct()
    options = _off(mine).unionByName(running)
    if previous is None or base_hour is None:
        return options
    return hold_mode(options, mine, previous, base_hour)


def hold_mode(options: DataFrame, effectors: DataFrame, previous: DataFrame, base_hour: Column) -> DataFrame:
    """Inside the hold window keep options of the previous mode only; re-issue it when there is none.

    `previous` has `(site_id, effector, prev_mode, prev_target)`; an effector without a row counts as off. A
    target of an off re-issue is 0, as an unknown set-point.
    """
    held = (
        effectors.filter(F.col("hold_start").isNotNull())
        .select("site_id", F.col("name").alias("effector"), "hold_start", "hold_end")
        .withColumn("__hour", base_hour)
        .filter(hour_in_window(F.col("__hour"), F.col("hold_start"), F.col("hold_end")))
        .join(previous, ["site_id", "effector"], "left")
        .select(
            "site_id", "effector", F.coalesce("prev_mode", F.lit("off")).alias("prev_mode"),
            F.coalesce("prev_target", F.lit(0.0)).alias("prev_target"), F.lit(True).alias("__held"),
        )
    )
    marked = options.join(held, ["site_id", "effector"], "left")
    kept = marked.filter(F.col("__held").isNull() | (F.col("mode") == F.col("prev_mode"))).select(*options.columns)
    missing = drop_keys(held, kept, ["site_id", "effector"]).select(
        "site_id", "effector", F.col("prev_mode").alias("mode"), F.col("prev_target").alias("target"),
        F.lit(0).alias("delay_steps"), F.lit(None).cast("int").alias("duration_steps"),
    )
    return kept.unionByName(missing)


def option_numbers(options: DataFrame, by: Sequence[str] = ("site_id",), owner: str = "effector") -> DataFrame:
    """Off first, then by mode, target, delay and run length."""
    order = [(F.col("mode") != "off"), F.col("mode"), F.col("target"), F.col("delay_steps"), F.col("duration_steps")]
    return numbered_choices(options, by, owner, order)


def expand_plans(options: DataFrame, dependents: DataFrame | None = None) -> DataFrame:
    """All plans as long rows `(site_id, plan_id, effector, option_no, mode, …)`; plan 0 is all off.

    `dependents` are effectors `(site_id, name, supported_modes, depends_on)` that vary only where all their
    parents run from the start; elsewhere they are off. Plans of independent effectors are numbered first. What the dependents
    may do is listed once per page for each set of them that may run; a plan looks up its set and is widened in place, so
    combinations that cannot occur are never generated and nothing is joined or gathered per plan.
    """
    numbered = option_numbers(options)
    if dependents is None:
        return combination_table(numbered, ["site_id"], "effector")
    numbered = numbered.select("site_id", "effector", "option_no", *OPTION)

    off_first = F.concat(
        F.filter("supported_modes", lambda m: m == "off"), F.filter("supported_modes", lambda m: m != "off")
    )
    kid = F.struct(F.col("name").alias("kid"), off_first.alias("modes"), F.col("depends_on").alias("parents"))
    kids = dependents.groupBy("site_id").agg(F.sort_array(F.collect_list(kid)).alias("kids"))
    pages = combination_pages(numbered, ["site_id"], "effector", kids).withColumn(
        "kids", F.coalesce("kids", F.array().cast("array<struct<kid:string,modes:array<string>,parents:array<string>>>"))
    )
    zero = F.lit(0).cast("bigint")
    bits = lambda ready: F.aggregate(F.transform("kids", ready), zero, lambda n, r: n * 2 + F.when(r, 1).otherwise(0))

    def allows(o: Column, c: Column) -> Column:
        """The dependents, one bit each, that an option leaves able to run."""
        starts = (c["mode"] != "off") & (c["delay_steps"] == 0)
        return bits(lambda k: F.coalesce(starts, F.lit(False)) | ~F.exists(k["parents"], lambda p: p.eqNullSafe(o["owner"])))

    # parents that are no owner here never start
    known = bits(lambda k: F.size(F.array_except(k["parents"], F.transform("__owners", lambda o: o["owner"]))) == 0)
    owners = F.transform("__owners", lambda o: F.struct(
        o["list"].alias("list"), o["size"].alias("size"), o["stride"].alias("stride"), F.transform(o["list"], lambda c: allows(o, c)).alias("allows")))
    row = "array<struct<effector:string,option_no:bigint,mode:string,target:double,delay_steps:int,duration_steps:int>>"

    def widened(able: Column) -> Column:
        """What the dependents may do where those with a bit in `able` may run: an array of combinations."""

        def widen(done: Column, k: Column, i: Column) -> Column:
            ready = F.call_function("div", able, F.pow(F.lit(2), F.size("kids") - 1 - i).cast("bigint")) % 2 == 1
            modes = F.when(ready, k["modes"]).otherwise(F.array(F.lit("off")))
            return F.flatten(
                F.transform(done, lambda d: F.transform(modes, lambda m: F.array_append(d, F.struct(
                    k["kid"].alias("effector"), (F.array_position(k["modes"], m) - 1).alias("option_no"), m.alias("mode"),
                    F.lit(None).cast("double").alias("target"), F.lit(0).alias("delay_steps"),
                    F.lit(None).cast("int").alias("duration_steps"),
                ))))
            )

        placed = F.transform("kids", lambda k, i: F.struct(k.alias("k"), i.alias("i")))
        return F.aggregate(placed, F.array(F.array().cast(row)), lambda done, p: widen(done, p["k"], p["i"]))

    per_base = F.aggregate("kids", F.lit(1).cast("bigint"), lambda n, k: n * F.size(k["modes"]))
    patterns = F.sequence(zero, F.pow(F.lit(2), F.size("kids")).cast("bigint") - 1)
    pages = pages.select(
        "site_id", "__first", "__last", owners.alias("__slots"), known.alias("__known"), per_base.alias("__per_base"),
        F.transform(patterns, widened).alias("__combos"),
    )
    base = F.col("base_id")
    able = F.aggregate("__slots", F.col("__known"), lambda n, o: n.bitwiseAND(F.get(o["allows"], option_index(base, o))))
    joined = pages.withColumn("base_id", F.explode(F.sequence("__first", "__last"))).select(
        "site_id", "base_id", "__per_base", F.transform("__slots", lambda o: F.get(o["list"], option_index(base, o))).alias("choices"),
        F.get("__combos", able.cast("int")).alias("combos"),
    )
    spread = joined.select("site_id", "base_id", "choices", "__per_base", F.posexplode("combos").alias("kid_id", "extra"))
    return spread.select(
        "site_id", (base * F.col("__per_base") + F.col("kid_id")).alias("plan_id"), F.explode(F.concat("choices", "extra")).alias("c")
    ).select("site_id", "plan_id", "c.*")


def advisory_options(devices: DataFrame, effects: Sequence[DataFrame]) -> DataFrame:
    """Choices for devices people operate; devices without a fitted effect are left out.

    `devices` has `(site_id, device, is_active, open_action, close_action)`. An active device may return to its
    default at 0, 1, 2 or 3 h; a resting one may be used now and return after 1, 2 or 3 h. Holding comes first.
    """
    relevant = with_effect(devices, effects)
    back = F.transform(F.array(*[F.lit(s) for s in RETURN_STEPS]), lambda s: F.struct(
        F.col("close_action").alias("action"), s.alias("transition_step"), F.lit(None).cast("int").alias("return_step")))
    use = F.transform(F.array(*[F.lit(s) for s in RETURN_STEPS[1:]]), lambda s: F.struct(
        F.col("open_action").alias("action"), F.lit(0).alias("transition_step"), s.alias("return_step")))
    hold = F.array(F.struct(
        F.lit("hold").alias("action"), F.lit(0).alias("transition_step"), F.lit(None).cast("int").alias("return_step")))
    choices = F.concat(hold, F.when(F.col("is_active"), back).otherwise(use))
    return relevant.select("site_id", "device", "is_active", F.posexplode(choices).alias("option_no", "c")).select(
        "site_id", "device", "is_active", F.col("option_no").cast("bigint").alias("option_no"), "c.*"
    )


def _coarse_mark(options: DataFrame) -> DataFrame:
    """Mark hold and the one best action of each device (a device has five options at most)."""
    acting = F.col("action") != "hold"
    late = (F.col("transition_step") != 0) | F.col("return_step").isNotNull()
    order = F.struct(late, F.coalesce("return_step", F.lit(2**30)), F.col("option_no"))
    window = Window.partitionBy("site_id", "device")
    ranked = options.withColumn("__best", F.min(F.when(acting, order)).over(window))
    return ranked.withColumn("__coarse", ~acting | (order == F.col("__best"))).drop("__best")


def coarse_advisory(options: DataFrame) -> DataFrame:
    """Hold plus one action per device: return at once if active, else the shortest use."""
    kept = _coarse_mark(options).filter("__coarse").drop("__coarse")
    return numbered_choices(kept.drop("option_no"), ["site_id"], "device", [F.col("action") != "hold"])


def cross_advisory(options: DataFrame, grid: Column) -> DataFrame:
    """Device combinations to put beside each plan.

    `grid` says per site what to build: `full` (every option), `coarse` (hold and the best action of each device) or
    `hold`. The caller chooses; nothing is left out because of its size. Long rows with `combo_id` and the grid.
    """
    marked = _coarse_mark(options).withColumn("grid", grid)
    kept = marked.filter(
        (F.col("grid") == "full") | ((F.col("grid") == "coarse") & F.col("__coarse")) | (F.col("action") == "hold")
    ).withColumnRenamed("option_no", "__no")
    numbered = numbered_choices(kept, ["site_id"], "device", [F.col("__no")]).drop("__no", "__coarse")
    return combination_table(numbered, ["site_id"], "device", "combo_id")


def plan_pairs(counts: DataFrame, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """Numbers of every plan with every device combination, from `(…, n_plans, n_combos)` alone.

    Pairs are read off a running number, page by page over many partitions, so no tables are joined.
    """
    total = F.col("n_plans") * F.col("n_combos")
    numbers = F.sequence(F.col("__page") * PAGE, F.least((F.col("__page") + 1) * PAGE, total) - 1)
    pages = spread_pages(counts.filter(total > 0), total, "__page", by)
    return pages.withColumn("pair_id", F.explode(numbers)).select(
        *by,
        "pair_id",
        F.floor(F.col("pair_id") / F.col("n_combos")).alias("plan_id"),
        (F.col("pair_id") % F.col("n_combos")).alias("combo_id"),
    )
