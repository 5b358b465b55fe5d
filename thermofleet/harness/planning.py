"""Comfort bounds, costs, options, plan scores and advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermofleet.harness import views as v
from thermofleet.harness.registry import query
from thermofleet.operators.aggregates import best_gain
from thermofleet.operators.lookup import combination_table
from thermofleet.plans import comfort as c
from thermofleet.plans import options as o
from thermofleet.plans import scoring as s

HOURS = v.schedules_sql(v.PLAN_SENSORS)
WEIGHT = "CASE step WHEN 12 THEN 1.0 WHEN 24 THEN 0.83 WHEN 48 THEN 0.36 ELSE 0.09 END"


def cost_sql(t: str, weight: str = WEIGHT, rail: float = 3.0) -> str:
    return (
        f"(CASE WHEN {t} < pref_lo THEN (pref_lo - {t}) * (pref_lo - {t}) * cold_penalty WHEN {t} > pref_hi THEN ({t} - pref_hi) * ({t} - pref_hi) * hot_penalty ELSE 0 END "
        f"+ {rail} * CASE WHEN {t} < acc_lo THEN (acc_lo - {t}) * (acc_lo - {t}) * cold_penalty WHEN {t} > acc_hi THEN ({t} - acc_hi) * ({t} - acc_hi) * hot_penalty ELSE 0 END) * {weight}"
    )


BOUNDED = (
    f"WITH {HOURS}, {v.PLAN_PREDICTIONS}, b AS (SELECT p.*, h.pref_lo, h.pref_hi, h.acc_lo, h.acc_hi, h.backup_lo, h.backup_hi, h.cold_penalty, h.hot_penalty "
    "FROM plan_predictions_v p LEFT JOIN hours_v h ON h.site_id = p.site_id AND h.sensor = p.sensor AND h.hour = (19 + p.step // 12) % 24)"
)


def hour():
    return F.lit(19)


@query("comfort_cost", BOUNDED + f" SELECT site_id, plan_id, round(sum({cost_sql('temp')}), 4) AS comfort_cost FROM b GROUP BY 1, 2")
def comfort_cost(spark, sf):
    out = c.comfort_cost(v.plan_predictions(spark, sf), v.plan_schedules(spark, sf), hour())
    return out.select("site_id", "plan_id", F.round("comfort_cost", 4).alias("comfort_cost"))


@query("comfort_cost_by_sensor", BOUNDED + f" SELECT site_id, plan_id, sensor, round(sum({cost_sql('temp')}), 4) AS comfort_cost FROM b GROUP BY 1, 2, 3")
def comfort_cost_by_sensor(spark, sf):
    out = c.comfort_cost(v.plan_predictions(spark, sf), v.plan_schedules(spark, sf), hour(), ("site_id", "plan_id", "sensor"))
    return out.withColumn("comfort_cost", F.round("comfort_cost", 4))


PROFILES = [(0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, -3.0, 6.0, -3.0, 2.0, 1.0), (2, 1.0, 0.0, -1.0, 1.0, 0.5)]
PROFILE_NAMES = ["k", "preferred_offset", "preferred_widen", "min_offset", "max_offset", "penalty_scale"]


def _profiles(spark, sf):
    kinds = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(PROFILE_NAMES, row)]) for row in PROFILES])
    return v.sites(spark, sf).filter(F.col("site_id") % 4 < 3).select("site_id", F.element_at(kinds, (F.col("site_id") % 4 + 1).cast("int")).alias("p")).select("site_id", "p.*").drop("k")


PROFILE_SQL = (
    f"profile_v AS (SELECT s.site_id, p.* FROM sites_v s JOIN (VALUES {v.values_sql(PROFILES)}) p({', '.join(PROFILE_NAMES)}) ON p.k = s.site_id % 4)"
)


@query("profile_bounds", f"""WITH {v.schedules_sql()}, {PROFILE_SQL} SELECT s.site_id, s.sensor, s.seq, pref_lo + coalesce(preferred_offset, 0) - coalesce(preferred_widen, 0) / 2 AS pref_lo,
pref_hi + coalesce(preferred_offset, 0) + coalesce(preferred_widen, 0) / 2 AS pref_hi, acc_lo + coalesce(min_offset, 0) AS acc_lo, acc_hi + coalesce(max_offset, 0) AS acc_hi,
backup_lo + coalesce(min_offset, 0) AS backup_lo, cold_penalty * coalesce(penalty_scale, 1) AS cold_penalty FROM schedule_v s LEFT JOIN profile_v p ON p.site_id = s.site_id""")
def profile_bounds(spark, sf):
    out = c.apply_profile(v.schedules(spark, sf), _profiles(spark, sf))
    return out.select("site_id", "sensor", "seq", "pref_lo", "pref_hi", "acc_lo", "acc_hi", "backup_lo", "cold_penalty")


@query("radiant_bounds", f"""WITH {v.STATES}, x AS (SELECT event_id, value AS outdoor, CAST(k AS DOUBLE) / 10 AS gain, CASE WHEN k % 4 = 0 THEN 0.0 ELSE 0.6 END AS sun, 0.5 + (k % 3) / 4.0 AS weight FROM states_v),
y AS (SELECT *, greatest(-2.0, least(2.0, 0.05 * (50 - outdoor))) AS base, greatest(-2.0, least(2.0, 0.05 * (50 - (outdoor + gain * sun * 0.5 * 1.5)))) * weight AS shift FROM x)
SELECT event_id, round(CASE WHEN (abs(base) < 0.05 AND sun * 0.5 < 0.001) OR abs(shift) < 0.05 THEN 0.0 ELSE shift END, 8) AS shift FROM y""")
def radiant_bounds(spark, sf):
    k = F.col("k")
    sun = F.when(k % 4 == 0, 0.0).otherwise(0.6)
    shift = c.radiant_offset(F.col("value"), k / 10.0, sun, F.lit(0.5), 0.5 + (k % 3) / 4.0, 0.05, 50.0, 2.0, 1.5)
    rows = v.states(spark, sf).withColumns({n: F.lit(0.0) for n in c.BOUND_COLUMNS})
    return c.shift_bounds(rows, shift).select("event_id", F.round("pref_lo", 8).alias("shift"))


def _plan_energy(spark, sf):
    return s.plan_energy(v.plan_options(spark, sf), v.effectors(spark, sf), v.current(spark, sf))


ENERGY = f"""{v.EFFECTORS_SQL}, {v.PLAN_OPTIONS}, {v.CURRENT}, en AS (SELECT p.site_id, p.plan_id, p.effector, CASE WHEN p.mode = 'off' OR e.name IS NULL THEN 0.0
WHEN e.control_type = 'trajectory' THEN e.flat_cost * coalesce(p.duration_steps, 72 - p.delay_steps) / 72.0
WHEN e.control_type = 'regulating' THEN e.flat_cost * CASE WHEN t.temp IS NULL OR p.target IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, CASE WHEN p.mode = 'heat' THEN p.target - t.temp ELSE t.temp - p.target END) / e.proportional_band) END * coalesce(p.duration_steps, 72 - p.delay_steps) / 72.0
ELSE CASE p.mode WHEN 'low' THEN e.low_cost ELSE e.high_cost END * coalesce(p.duration_steps, 72 - p.delay_steps) / 72.0 END AS cost
FROM plan_options_v p LEFT JOIN effectors_v e ON e.site_id = p.site_id AND e.name = p.effector LEFT JOIN current_v t ON t.site_id = p.site_id AND t.sensor = e.temp_sensor)"""


@query("energy_cost", f"WITH {ENERGY} SELECT site_id, plan_id, round(sum(cost), 6) AS energy_cost FROM en GROUP BY 1, 2")
def energy_cost(spark, sf):
    return _plan_energy(spark, sf).withColumn("energy_cost", v.r6("energy_cost"))


# ── options: every part is a site with up to four effectors ────────────────
MODES = ["heating", "high", "low", "off"]  # of _part_effectors


def _part_effectors(spark, sf):
    p = v.table(spark, sf, "part")

    def one(name, kind, modes, parents, when):
        return F.when(when, F.struct(
            F.lit(name).alias("name"), F.lit(kind).alias("control_type"), F.array(*[F.lit(m) for m in modes]).alias("supported_modes"),
            F.array(*[F.lit(x) for x in parents]).cast("array<string>").alias("depends_on"),
        ))

    yes = F.lit(True)
    items = F.array_compact(F.array(
        one("t1", "trajectory", ["off", "heating"], [], yes), one("b1", "binary", ["off", "low"], [], F.col("p_size") % 2 == 0),
        one("x1", "binary", ["off", "low", "high"], ["t1"], F.col("p_size") % 3 == 0),
        one("x2", "binary", ["off", "high"], ["t1", "b1"], F.col("p_size") % 4 == 0),
    ))
    return p.select(F.col("p_partkey").alias("site_id"), F.explode(items).alias("e")).select("site_id", "e.*")


TIMING = "(VALUES (0, 12), (0, 24), (0, 72), (12, 12), (12, 24), (12, 60), (24, 12), (24, 24), (24, 48)) t(delay_steps, duration_steps)"
BLOCKED_PARTS = "p_retailprice > 1500"
OPTIONS = f"""free AS (SELECT p_partkey AS site_id, 't1' AS effector, 'heating' AS mode, {BLOCKED_PARTS} AS held FROM part UNION ALL SELECT p_partkey, 'b1', 'low', false FROM part WHERE p_size % 2 = 0),
opts AS (SELECT site_id, effector, 'off' AS mode, 0 AS delay_steps, NULL AS duration_steps FROM free UNION ALL SELECT site_id, effector, mode, t.delay_steps, t.duration_steps FROM free CROSS JOIN {TIMING} WHERE NOT held)"""


def _blocked_parts(spark, sf):
    p = v.table(spark, sf, "part").filter(F.col("p_retailprice") > 1500)
    return p.select(F.col("p_partkey").alias("site_id"), F.lit("t1").alias("effector"))


@query("options_grid", f"WITH {OPTIONS} SELECT * FROM opts")
def options_grid(spark, sf):
    out = o.timed_options(_part_effectors(spark, sf), _blocked_parts(spark, sf))
    return out.select("site_id", "effector", "mode", "delay_steps", "duration_steps")


@query("plan_expansion", f"""WITH {OPTIONS}, a AS (SELECT * FROM opts WHERE effector = 't1'), b AS (SELECT * FROM opts WHERE effector = 'b1'),
base AS (SELECT a.site_id, a.mode AS m1, a.mode <> 'off' AND a.delay_steps = 0 AS on1, coalesce(b.mode, 'none') AS m2, coalesce(b.mode <> 'off' AND b.delay_steps = 0, false) AS on2 FROM a LEFT JOIN b ON a.site_id = b.site_id),
x1 AS (SELECT p_partkey AS site_id, u.m FROM part CROSS JOIN (VALUES ('off'), ('low'), ('high')) u(m) WHERE p_size % 3 = 0), x2 AS (SELECT p_partkey AS site_id, u.m FROM part CROSS JOIN (VALUES ('off'), ('high')) u(m) WHERE p_size % 4 = 0),
w AS (SELECT base.*, coalesce(x1.m, 'none') AS m3 FROM base LEFT JOIN x1 ON x1.site_id = base.site_id AND (base.on1 OR x1.m = 'off')),
z AS (SELECT w.*, coalesce(x2.m, 'none') AS m4 FROM w LEFT JOIN x2 ON x2.site_id = w.site_id AND ((w.on1 AND w.on2) OR x2.m = 'off'))
SELECT site_id, m1, m2, m3, m4, count(*) AS n_plans FROM z GROUP BY ALL""")
def plan_expansion(spark, sf):
    e = _part_effectors(spark, sf)
    options = o.timed_options(e, _blocked_parts(spark, sf))
    plans = o.expand_plans(options, e.filter(F.size("depends_on") > 0))
    # modes as numbers in their order: their maximum is kept in place, strings would be sorted row by row
    named = F.array(*[F.lit(m) for m in MODES])
    number = F.array_position(named, F.col("mode"))
    pick = {f"m{i + 1}": F.max(F.when(F.col("effector") == n, number)) for i, n in enumerate(["t1", "b1", "x1", "x2"])}
    per = plans.groupBy("site_id", "plan_id").agg(*[x.alias(k) for k, x in pick.items()])
    counted = per.groupBy("site_id", *pick).agg(F.count(F.lit(1)).alias("n_plans"))
    return counted.withColumns({k: F.when(F.col(k).isNull(), "none").otherwise(F.get(named, (F.col(k) - 1).cast("int"))) for k in pick})


@query("combination_numbers", f"""WITH {OPTIONS}, n AS (SELECT site_id, effector, count(*) AS n FROM opts GROUP BY 1, 2) SELECT site_id, CAST(round(exp(sum(ln(n)))) AS BIGINT) AS n_plans, CAST(round(exp(sum(ln(n)))) AS BIGINT) * count(*) AS n_rows FROM n GROUP BY 1""")
def combination_numbers(spark, sf):
    options = o.option_numbers(o.timed_options(_part_effectors(spark, sf), _blocked_parts(spark, sf)))
    plans = combination_table(options, ["site_id"], "effector")
    # plans per site counted by their distinct first-owner slots: one row per plan carries the first effector
    return plans.groupBy("site_id").agg((F.max("plan_id") + 1).alias("n_plans"), F.count(F.lit(1)).alias("n_rows"))


@query("blocked_effectors", f"WITH {v.EFFECTORS_SQL}, {v.CURRENT}, {v.BOUNDS} SELECT e.site_id, e.name AS effector, t.temp, b.acc_hi AS ceiling FROM effectors_v e JOIN current_v t ON t.site_id = e.site_id AND t.sensor = e.temp_sensor JOIN bounds_v b ON b.site_id = e.site_id AND b.sensor = e.temp_sensor WHERE e.control_type = 'trajectory' AND t.temp >= b.acc_hi")
def blocked_effectors(spark, sf):
    return o.blocked_effectors(v.effectors(spark, sf), v.current(spark, sf), v.bounds(spark, sf))


def _regulating_sql(held: bool) -> str:
    base = f"""WITH RECURSIVE {v.EFFECTORS_SQL}, {v.GAINS}, {v.CURRENT}, {v.BOUNDS},
felt AS (SELECT g.* FROM gains_v g JOIN effectors_v e ON e.site_id = g.site_id AND e.name = g.effector WHERE e.control_type = 'regulating' AND g.gain_f_per_hour <> 0),
aim AS (SELECT DISTINCT f.site_id, f.effector, m.mode, CASE m.mode WHEN 'heat' THEN b.pref_lo ELSE b.pref_hi END AS t FROM felt f JOIN bounds_v b ON b.site_id = f.site_id AND b.sensor = f.sensor CROSS JOIN (VALUES ('heat'), ('cool')) m(mode)),
nxt AS (SELECT a.site_id, a.effector, a.mode, a.t, min(b.t) AS nt FROM aim a JOIN aim b ON a.site_id = b.site_id AND a.effector = b.effector AND a.mode = b.mode AND b.t - a.t > 0.5 GROUP BY 1, 2, 3, 4),
kept AS (SELECT site_id, effector, mode, min(t) AS t FROM aim GROUP BY 1, 2, 3 UNION ALL SELECT n.site_id, n.effector, n.mode, n.nt FROM kept k JOIN nxt n ON n.site_id = k.site_id AND n.effector = k.effector AND n.mode = k.mode AND n.t = k.t),
ref AS (SELECT f.site_id, f.effector, arg_max(c.temp, (abs(f.gain_f_per_hour), f.sensor)) AS temp FROM felt f JOIN current_v c ON c.site_id = f.site_id AND c.sensor = f.sensor GROUP BY 1, 2),
run AS (SELECT DISTINCT k.site_id, k.effector, k.mode, round(k.t, 1) AS target, t.delay_steps, t.duration_steps FROM kept k JOIN effectors_v e ON e.site_id = k.site_id AND e.name = k.effector LEFT JOIN ref r ON r.site_id = k.site_id AND r.effector = k.effector CROSS JOIN {TIMING}
WHERE NOT coalesce(CASE k.mode WHEN 'heat' THEN r.temp > k.t + e.proportional_band ELSE r.temp < k.t - e.proportional_band END, false)),
alls AS (SELECT site_id, name AS effector, 'off' AS mode, CAST(NULL AS DOUBLE) AS target, 0 AS delay_steps, CAST(NULL AS INTEGER) AS duration_steps FROM effectors_v WHERE control_type = 'regulating' UNION ALL SELECT * FROM run)"""
    if not held:
        return base + " SELECT * FROM alls"
    return base + """, prev AS (SELECT site_id, name AS effector, CASE site_id % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'cool' ELSE 'dry' END AS mode, CASE WHEN site_id % 3 = 1 THEN CAST(68.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS target FROM effectors_v WHERE name IN ('e4', 'e5')),
k2 AS (SELECT a.* FROM alls a LEFT JOIN prev p ON p.site_id = a.site_id AND p.effector = a.effector WHERE p.mode IS NULL OR p.mode = a.mode)
SELECT * FROM k2 UNION ALL SELECT p.site_id, p.effector, p.mode, p.target, 0, NULL FROM prev p WHERE NOT EXISTS (SELECT 1 FROM k2 WHERE k2.site_id = p.site_id AND k2.effector = p.effector)"""


REGULATING = ["site_id", "effector", "mode", "target", "delay_steps", "duration_steps"]


@query("regulating_options", _regulating_sql(False))
def regulating_options(spark, sf):
    return o.regulating_options(v.effectors(spark, sf), v.gains(spark, sf), v.bounds(spark, sf), v.current(spark, sf)).select(*REGULATING)


@query("mode_hold", _regulating_sql(True))
def mode_hold(spark, sf):
    e = v.effectors(spark, sf)
    third = F.col("site_id") % 3
    previous = e.filter(F.col("name").isin("e4", "e5") & (third != 0)).select(
        "site_id", F.col("name").alias("effector"), F.when(third == 1, "cool").otherwise("dry").alias("prev_mode"), F.when(third == 1, 68.0).alias("prev_target"))
    return o.regulating_options(e, v.gains(spark, sf), v.bounds(spark, sf), v.current(spark, sf), previous, F.lit(23)).select(*REGULATING)


# ── advisory: every customer is a site, devices come from the orders ───────
DEVICES = """dev AS (SELECT o_custkey AS site_id, 'd' || (o_orderkey % 5) AS device, max(o_orderstatus) = 'P' AS is_active, count(*) AS n FROM orders GROUP BY 1, 2), rel AS (SELECT * FROM dev WHERE n >= 2 OR device <> 'd0')"""
ADVICE = DEVICES + """, adv AS (SELECT site_id, device, is_active, 'hold' AS action, 0 AS transition_step, NULL AS return_step FROM rel
UNION ALL SELECT site_id, device, is_active, 'close', s.s, NULL FROM rel CROSS JOIN (VALUES (0), (12), (24), (36)) s(s) WHERE is_active
UNION ALL SELECT site_id, device, is_active, 'open', 0, s.s FROM rel CROSS JOIN (VALUES (12), (24), (36)) s(s) WHERE NOT is_active)"""


def _advice(spark, sf):
    d = v.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("site_id"), F.concat(F.lit("d"), (F.col("o_orderkey") % 5).cast("string")).alias("device")).agg(
        (F.max("o_orderstatus") == "P").alias("is_active"), F.count(F.lit(1)).alias("n"))
    devices = d.withColumns({"open_action": F.lit("open"), "close_action": F.lit("close")})
    return o.advisory_options(devices, [d.filter(F.col("n") >= 2), d.filter(F.col("device") != "d0")])


@query("advisory_options", f"WITH {ADVICE} SELECT site_id, device, is_active, action, transition_step, return_step FROM adv")
def advisory_options(spark, sf):
    return _advice(spark, sf).select("site_id", "device", "is_active", "action", "transition_step", "return_step")


@query("coarse_advisory", f"WITH {ADVICE} SELECT site_id, device, action, return_step FROM adv WHERE action = 'hold' OR (is_active AND transition_step = 0) OR return_step = 12")
def coarse_advisory(spark, sf):
    return o.coarse_advisory(_advice(spark, sf)).select("site_id", "device", "action", "return_step")


def cross_sql(kept: str) -> str:
    """All combinations of the kept options of every site."""
    return f"""WITH {ADVICE}, k AS (SELECT * FROM adv WHERE {kept}),
n AS (SELECT *, row_number() OVER (PARTITION BY site_id, device ORDER BY action <> 'hold', transition_step, return_step) - 1 AS option_no, count(*) OVER (PARTITION BY site_id, device) AS size FROM k),
d AS (SELECT DISTINCT site_id, device, size FROM n),
z AS (SELECT site_id, device, size, CAST(round(exp(coalesce(sum(ln(size)) OVER (PARTITION BY site_id ORDER BY device DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS stride, CAST(round(exp(sum(ln(size)) OVER (PARTITION BY site_id))) AS BIGINT) AS total FROM d),
c AS (SELECT site_id, device, size, stride, unnest(range(total)) AS combo_id FROM z)
SELECT n.site_id, combo_id, n.device, action, transition_step, return_step FROM c JOIN n ON n.site_id = c.site_id AND n.device = c.device AND n.option_no = (c.combo_id // c.stride) % c.size"""


def _crossed(spark, sf, grid):
    return o.cross_advisory(_advice(spark, sf), F.lit(grid)).select("site_id", "combo_id", "device", "action", "transition_step", "return_step")


@query("advisory_cross_full", cross_sql("true"))
def advisory_cross_full(spark, sf):
    return _crossed(spark, sf, "full")


@query("advisory_cross_coarse", cross_sql("action = 'hold' OR (is_active AND transition_step = 0) OR (NOT is_active AND return_step = 12)"))
def advisory_cross_coarse(spark, sf):
    return _crossed(spark, sf, "coarse")


@query("plan_pairs", "WITH c AS (SELECT o_custkey AS site_id, count(*) AS n_plans, count(*) % 4 + 1 AS n_combos FROM orders GROUP BY 1) SELECT site_id, p.p AS plan_id, q.q AS combo_id FROM c, LATERAL (SELECT unnest(range(n_plans)) AS p) p, LATERAL (SELECT unnest(range(n_combos)) AS q) q")
def plan_pairs(spark, sf):
    n = F.count(F.lit(1))
    counts = v.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("site_id")).agg(n.alias("n_plans"), (n % 4 + 1).alias("n_combos"))
    return o.plan_pairs(counts).select("site_id", "plan_id", "combo_id")


# ── scores ─────────────────────────────────────────────────────────────────
MARGINALS = """base_v AS (SELECT l_suppkey % 16 AS site_id, 's' || (l_partkey % 8) AS sensor, CASE l_linenumber % 4 WHEN 0 THEN 12 WHEN 1 THEN 24 WHEN 2 THEN 48 ELSE 72 END AS step, max(l_quantity) / 2 + 40 AS base_temp FROM lineitem GROUP BY 1, 2, 3),
marg_v AS (SELECT l_suppkey % 16 AS site_id, 'e' || (l_partkey % 12) AS effector, CAST(l_linenumber AS BIGINT) AS option_no, 's' || (l_orderkey % 8) AS sensor, CASE l_linenumber % 4 WHEN 0 THEN 12 WHEN 1 THEN 24 WHEN 2 THEN 48 ELSE 72 END AS step, CAST(sum(l_quantity) AS BIGINT) % 11 / CAST(4.0 AS DOUBLE) AS delta FROM lineitem GROUP BY 1, 2, 3, 4, 5)"""
ADDITIVE = f"""{v.PLAN_OPTIONS}, {MARGINALS}, d AS (SELECT p.site_id, p.plan_id, m.sensor, m.step, sum(m.delta) AS delta FROM plan_options_v p JOIN marg_v m ON m.site_id = p.site_id AND m.effector = p.effector AND m.option_no = p.option_no GROUP BY 1, 2, 3, 4),
temps AS (SELECT pl.site_id, pl.plan_id, b.sensor, b.step, b.base_temp + coalesce(d.delta, 0.0) AS temp FROM (SELECT DISTINCT site_id, plan_id FROM plan_options_v) pl JOIN base_v b ON b.site_id = pl.site_id LEFT JOIN d ON d.site_id = pl.site_id AND d.plan_id = pl.plan_id AND d.sensor = b.sensor AND d.step = b.step)"""


def _temps(spark, sf):
    l = v.table(spark, sf, "lineitem")
    step = F.element_at(F.array(F.lit(12), F.lit(24), F.lit(48), F.lit(72)), F.col("l_linenumber") % 4 + 1)
    site = (F.col("l_suppkey") % 16).alias("site_id")
    base = l.groupBy(site, F.concat(F.lit("s"), (F.col("l_partkey") % 8).cast("string")).alias("sensor"), step.alias("step")).agg((F.max("l_quantity") / 2 + 40).alias("base_temp"))
    marginals = l.groupBy(site, F.concat(F.lit("e"), (F.col("l_partkey") % 12).cast("string")).alias("effector"), F.col("l_linenumber").cast("bigint").alias("option_no"),
                          F.concat(F.lit("s"), (F.col("l_orderkey") % 8).cast("string")).alias("sensor"), step.alias("step")).agg((F.sum("l_quantity").cast("bigint") % 11 / 4.0).alias("delta"))
    return s.additive_predictions(v.plan_options(spark, sf), base, marginals)


@query("additive_predictions", f"WITH {ADDITIVE} SELECT site_id, plan_id, sensor, step, temp FROM temps")
def additive_predictions(spark, sf):
    return _temps(spark, sf)


SCORES = f"""{HOURS}, {ADDITIVE}, {ENERGY.replace(v.PLAN_OPTIONS + ', ', '')}, e AS (SELECT site_id, plan_id, sum(cost) AS energy FROM en GROUP BY 1, 2),
k AS (SELECT t.site_id, t.plan_id, sum(coalesce({cost_sql('t.temp', WEIGHT.replace('step', 't.step'))}, 0)) AS comfort FROM temps t LEFT JOIN hours_v h ON h.site_id = t.site_id AND h.sensor = t.sensor AND h.hour = (19 + t.step // 12) % 24 GROUP BY 1, 2)"""


@query("additive_score", f"WITH {SCORES} SELECT k.site_id, k.plan_id, round(comfort, 8) AS comfort_cost, round(energy, 6) AS energy_cost, round(comfort + energy, 6) AS total_cost FROM k JOIN e ON e.site_id = k.site_id AND e.plan_id = k.plan_id")
def additive_score(spark, sf):
    out = s.plan_scores(_temps(spark, sf), _plan_energy(spark, sf), v.plan_schedules(spark, sf), hour())
    return out.select("site_id", "plan_id", *[F.round(x, d).alias(x) for x, d in (("comfort_cost", 8), ("energy_cost", 6), ("total_cost", 6))])


COSTS = """costs_v AS (SELECT l_partkey % 16 AS site_id, l_partkey // 16 AS plan_id, CASE WHEN l_partkey // 16 = 0 AND l_partkey % 2 = 0 THEN 0.0 ELSE CAST(sum(l_quantity) AS BIGINT) % 997 / CAST(10.0 AS DOUBLE) END AS total_cost FROM lineitem GROUP BY 1, 2, l_partkey)"""


def _costs(spark, sf):
    l = v.table(spark, sf, "lineitem")
    p = F.col("l_partkey")
    out = l.groupBy("l_partkey").agg((F.sum("l_quantity").cast("bigint") % 997 / 10.0).alias("x"))
    plan = F.floor(p / 16)
    return out.select((p % 16).alias("site_id"), plan.alias("plan_id"), F.when((plan == 0) & (p % 2 == 0), 0.0).otherwise(F.col("x")).alias("total_cost"))


@query("topk_plans", f"WITH {COSTS}, r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY total_cost, plan_id) AS rank FROM costs_v) SELECT site_id, plan_id, total_cost, CAST(CASE WHEN rank <= 10 THEN rank END AS INTEGER) AS rank FROM r WHERE rank <= 10 OR plan_id = 0")
def topk_plans(spark, sf):
    return s.shortlist(_costs(spark, sf), 10)


@query("cheapest_plan", f"WITH {COSTS} SELECT site_id, plan_id, total_cost FROM costs_v QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY total_cost, plan_id) = 1")
def cheapest_plan(spark, sf):
    return s.rank_costs(_costs(spark, sf))


@query("cold_rescue", f"""WITH {COSTS}, {v.GAINS}, {v.EFFECTORS_SQL}, {v.CURRENT}, {v.BOUNDS}, {v.PLAN_OPTIONS},
best AS (SELECT site_id, arg_min(plan_id, (total_cost, plan_id)) AS p FROM costs_v GROUP BY 1 HAVING p = 0),
em AS (SELECT g.site_id, g.sensor, g.effector FROM gains_v g JOIN effectors_v e ON e.site_id = g.site_id AND e.name = g.effector WHERE e.control_type = 'trajectory' AND gain_f_per_hour > 0 QUALIFY row_number() OVER (PARTITION BY g.site_id, g.sensor ORDER BY gain_f_per_hour DESC, g.effector) = 1),
bl AS (SELECT e.site_id, e.name AS effector FROM effectors_v e JOIN current_v t ON t.site_id = e.site_id AND t.sensor = e.temp_sensor JOIN bounds_v b ON b.site_id = e.site_id AND b.sensor = e.temp_sensor WHERE e.control_type = 'trajectory' AND t.temp >= b.acc_hi),
cold AS (SELECT DISTINCT em.site_id, em.effector FROM current_v t JOIN bounds_v b ON b.site_id = t.site_id AND b.sensor = t.sensor JOIN best ON best.site_id = t.site_id JOIN em ON em.site_id = t.site_id AND em.sensor = t.sensor WHERE t.temp < b.acc_lo - 1 AND NOT EXISTS (SELECT 1 FROM bl WHERE bl.site_id = em.site_id AND bl.effector = em.effector)),
need AS (SELECT site_id, count(*) AS n FROM cold GROUP BY 1), run AS (SELECT p.site_id, p.plan_id, count(*) AS n FROM plan_options_v p JOIN cold c ON c.site_id = p.site_id AND c.effector = p.effector WHERE p.mode <> 'off' AND p.delay_steps = 12 GROUP BY 1, 2)
SELECT c.site_id, arg_min(c.plan_id, (c.total_cost, c.plan_id)) AS plan_id, min(c.total_cost) AS total_cost FROM costs_v c JOIN run ON run.site_id = c.site_id AND run.plan_id = c.plan_id JOIN need ON need.site_id = c.site_id AND need.n = run.n GROUP BY 1""")
def cold_rescue(spark, sf):
    # the derived plans start twelve steps late at the earliest, so that start counts as "at once" here
    options = v.plan_options(spark, sf).withColumn("delay_steps", F.col("delay_steps") - 12)
    e, now, b = v.effectors(spark, sf), v.current(spark, sf), v.bounds(spark, sf)
    return s.cold_rescue(_costs(spark, sf), options, now, b, best_gain(v.gains(spark, sf), e), o.blocked_effectors(e, now, b))


ADVISED = COSTS + """, adv AS (SELECT l_partkey % 16 AS site_id, l_partkey // 16 AS plan_id, 'd' || (l_suppkey % 3) AS device, CAST(sum(l_linenumber) % 7 + 1 AS INTEGER) AS ln FROM lineitem GROUP BY 1, 2, 3),
advised AS (SELECT c.site_id, c.plan_id, c.total_cost, a.device, CASE WHEN a.ln < 5 THEN 'hold' WHEN a.ln = 5 THEN 'close' WHEN a.ln > 5 THEN 'open' END AS action, CASE WHEN a.ln = 5 THEN 12 ELSE 0 END AS transition_step, CASE WHEN a.ln > 5 THEN a.ln * 6 END AS return_step FROM costs_v c LEFT JOIN adv a ON a.site_id = c.site_id AND a.plan_id = c.plan_id),
bp AS (SELECT site_id, plan_id, total_cost FROM advised GROUP BY 1, 2, 3 HAVING bool_and(coalesce(action, 'hold') = 'hold')), bs AS (SELECT site_id, arg_min(plan_id, (total_cost, plan_id)) AS baseline_plan, min(total_cost) AS baseline_cost FROM bp GROUP BY 1)"""


def _advised(spark, sf):
    l = v.table(spark, sf, "lineitem")
    p = F.col("l_partkey")
    a = l.groupBy((p % 16).alias("site_id"), F.floor(p / 16).alias("plan_id"), F.concat(F.lit("d"), (F.col("l_suppkey") % 3).cast("string")).alias("device")).agg((F.sum("l_linenumber") % 7 + 1).cast("int").alias("ln"))
    j = _costs(spark, sf).join(a, ["site_id", "plan_id"], "left")
    ln = F.col("ln")
    return j.select("site_id", "plan_id", "total_cost", "device", F.when(ln < 5, "hold").when(ln == 5, "close").when(ln > 5, "open").alias("action"),
                    F.when(ln == 5, 12).otherwise(0).alias("transition_step"), F.when(ln > 5, ln * 6).alias("return_step"))


@query("baseline_vs_change", f"""WITH {ADVISED}, d AS (SELECT site_id, device, arg_min(plan_id, (total_cost, plan_id)) FILTER (WHERE action <> 'hold') AS plan_id, min(total_cost) FILTER (WHERE action <> 'hold') AS c, min(total_cost) FILTER (WHERE action = 'hold') AS h FROM advised WHERE device IS NOT NULL GROUP BY 1, 2)
SELECT d.site_id, d.device, d.plan_id, a.action, round(d.c - coalesce(d.h, bs.baseline_cost), 6) AS cost_delta FROM d LEFT JOIN bs ON bs.site_id = d.site_id JOIN advised a ON a.site_id = d.site_id AND a.plan_id = d.plan_id AND a.device = d.device WHERE d.c IS NOT NULL AND coalesce(d.h, bs.baseline_cost) IS NOT NULL""")
def baseline_vs_change(spark, sf):
    return s.device_opportunities(_advised(spark, sf)).select("site_id", "device", "plan_id", "action", v.r6("cost_delta").alias("cost_delta"))


@query("opportunities", f"""WITH {ADVISED}, d AS (SELECT site_id, device, arg_min(plan_id, (total_cost, plan_id)) FILTER (WHERE action <> 'hold') AS plan_id, min(total_cost) FILTER (WHERE action <> 'hold') AS c, min(total_cost) FILTER (WHERE action = 'hold') AS h FROM advised WHERE device IS NOT NULL GROUP BY 1, 2)
SELECT d.site_id, d.device, a.transition_step * 5 AS in_minutes, (a.return_step - a.transition_step) * 5 AS duration_minutes, round(d.c - coalesce(d.h, bs.baseline_cost), 4) AS cost_delta FROM d LEFT JOIN bs ON bs.site_id = d.site_id JOIN advised a ON a.site_id = d.site_id AND a.plan_id = d.plan_id AND a.device = d.device WHERE d.c - coalesce(d.h, bs.baseline_cost) < 0""")
def opportunities(spark, sf):
    found = s.opportunities(s.device_opportunities(_advised(spark, sf)))
    return found.select("site_id", "device", "in_minutes", "duration_minutes", "cost_delta")


@query("baseline_plan", f"WITH {ADVISED} SELECT * FROM bs")
def baseline_plan(spark, sf):
    return s.baseline_plan(_advised(spark, sf))


BREACH = " SELECT site_id, plan_id, sensor, step, CASE WHEN temp < backup_lo THEN 'below' ELSE 'above' END AS side, CASE WHEN temp < backup_lo THEN backup_lo ELSE backup_hi END AS bound FROM b WHERE temp < backup_lo - 0 OR temp > backup_hi"


def _cool(spark, sf):
    return v.plan_predictions(spark, sf).withColumn("temp", F.col("temp") * 2 - 15.0)


@query("backup_breaches", BOUNDED.replace("SELECT p.*, h.pref_lo", "SELECT p.site_id, p.plan_id, p.sensor, p.step, p.temp * 2 - 15 AS temp, h.pref_lo") + BREACH)
def backup_breaches(spark, sf):
    out = c.backup_breaches(_cool(spark, sf), v.plan_schedules(spark, sf), hour())
    return out.select("site_id", "plan_id", "sensor", "step", "side", "bound")


@query("breach_override", f"""WITH {ADVISED}, {v.PLAN_OPTIONS}, act AS (SELECT site_id, plan_id, bool_or(mode <> 'off') AS runs FROM plan_options_v WHERE plan_id > 0 GROUP BY 1, 2),
best AS (SELECT site_id, plan_id FROM costs_v QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY total_cost, plan_id) = 1),
j AS (SELECT best.site_id, best.plan_id, bs.baseline_plan, best.site_id % 3 <> 0 AND coalesce(a1.runs, false) AND NOT coalesce(a2.runs, false) AS o FROM best LEFT JOIN bs ON bs.site_id = best.site_id LEFT JOIN act a1 ON a1.site_id = bs.site_id AND a1.plan_id = bs.baseline_plan LEFT JOIN act a2 ON a2.site_id = best.site_id AND a2.plan_id = best.plan_id)
SELECT site_id, CASE WHEN o THEN baseline_plan ELSE plan_id END AS plan_id, o AS overridden FROM j""")
def breach_override(spark, sf):
    costs = _costs(spark, sf)
    breaches = costs.filter(F.col("site_id") % 3 != 0).select("site_id")
    advised = _advised(spark, sf)
    return s.breach_override(s.rank_costs(costs), s.baseline_plan(advised), breaches, v.plan_options(spark, sf).filter(F.col("plan_id") > 0))


@query("attribution", f"""WITH {HOURS}, {v.PLAN_PREDICTIONS}, j AS (SELECT w.site_id, w.plan_id, w.sensor, w.step, w.temp AS wt, p.temp AS pt, h.* EXCLUDE (site_id, sensor) FROM plan_predictions_v w JOIN plan_predictions_v p ON p.plan_id = 0 AND p.site_id = w.site_id AND p.sensor = w.sensor AND p.step = w.step LEFT JOIN hours_v h ON h.site_id = w.site_id AND h.sensor = w.sensor AND h.hour = (19 + w.step // 12) % 24 WHERE w.plan_id > 0),
s AS (SELECT site_id, plan_id, sensor, sum(coalesce({cost_sql('wt')} - {cost_sql('pt')}, 0)) AS saving, max(abs(pt - wt)) AS gap FROM j GROUP BY 1, 2, 3)
SELECT site_id, 'p' || plan_id AS device, round(sum(saving), 4) AS total_saving, round(max(abs(saving)), 4) AS top_saving, count(*) AS n_sensors FROM s GROUP BY site_id, plan_id""")
def attribution(spark, sf):
    p = v.plan_predictions(spark, sf)
    chosen = p.filter(F.col("plan_id") == 0).drop("plan_id")
    without = p.filter(F.col("plan_id") > 0).withColumn("device", F.concat(F.lit("p"), F.col("plan_id").cast("string"))).drop("plan_id")
    out = s.attribution(chosen, without, v.plan_schedules(spark, sf), hour())
    n = without.join(chosen.select("site_id", "sensor", "step"), ["site_id", "sensor", "step"], "left_semi").groupBy("site_id", "device").agg(F.countDistinct("sensor").alias("n_sensors"))
    return out.join(n, ["site_id", "device"]).select("site_id", "device", F.round("total_saving", 4).alias("total_saving"), F.round(F.abs("sensor_saving"), 4).alias("top_saving"), "n_sensors")


@query("normalized_benefit", f"WITH {COSTS}, b AS (SELECT a.site_id, a.plan_id, (z.total_cost - a.total_cost) / (8 * CAST(2.28 AS DOUBLE)) + (a.plan_id % 5) / 10.0 AS benefit FROM costs_v a JOIN costs_v z ON z.site_id = a.site_id AND z.plan_id = 0) SELECT site_id, plan_id, round(benefit, 6) AS benefit, benefit > 0.3 AS track, benefit > 1.5 AS announce FROM b")
def normalized_benefit(spark, sf):
    costs = _costs(spark, sf)
    zero = costs.filter(F.col("plan_id") == 0).select("site_id", F.col("total_cost").alias("old_comfort"))
    pairs = costs.join(zero, ["site_id"]).withColumns({"new_comfort": F.col("total_cost"), "old_energy": (F.col("plan_id") % 5) / 10.0, "new_energy": F.lit(0.0)})
    out = s.normalized_benefit(pairs, F.lit(8))
    return out.select("site_id", "plan_id", v.r6("benefit").alias("benefit"), "track", "announce")


@query("envelope", f"""WITH {v.PLAN_PREDICTIONS}, {v.CURRENT}, p AS (SELECT site_id, sensor, step, temp * 2 - 5 AS temp FROM plan_predictions_v),
a AS (SELECT site_id, sensor, step, min(temp) AS lo, max(temp) AS hi, median(temp) AS mid, count(*) FILTER (WHERE temp > 100) AS n_high, count(*) FILTER (WHERE temp < 35) AS n_low, count(*) AS n_plans FROM p GROUP BY 1, 2, 3),
j AS (SELECT a.*, c.temp AS cur FROM a JOIN current_v c ON c.site_id = a.site_id AND c.sensor = a.sensor)
SELECT site_id, sensor, step, 'prediction_range_high' AS "check", 'error' AS severity, round(hi, 6) AS value, n_high, n_low, n_plans FROM j WHERE hi > 100
UNION ALL SELECT site_id, sensor, step, 'prediction_range_low', 'error', round(lo, 6), n_high, n_low, n_plans FROM j WHERE lo < 35
UNION ALL SELECT site_id, sensor, step, 'prediction_rate', 'warning', round(mid, 6), n_high, n_low, n_plans FROM j WHERE abs(mid - cur) > 8.0 * step / 12.0
UNION ALL SELECT site_id, sensor, step, 'prediction_spread', 'warning', round(hi - lo, 6), n_high, n_low, n_plans FROM j WHERE hi - lo > 30""")
def envelope(spark, sf):
    p = v.plan_predictions(spark, sf).withColumn("temp", F.col("temp") * 2 - 5)
    return s.prediction_envelope(p, v.current(spark, sf)).withColumn("value", v.r6("value"))


@query("decision_sanity", f"""WITH {v.STATES}, p AS (SELECT site_id, event_id, 's' AS sensor, ['1h', '2h', '4h', '6h'][k % 4 + 1] AS horizon, [1, 2, 4, 6][k % 4 + 1] AS hours, value AS predicted, 40.0 + k / 5.0 AS cur FROM states_v)
SELECT event_id, 'first_hour_change' AS rule FROM p WHERE horizon = '1h' AND abs(predicted - cur) > 5 UNION ALL SELECT event_id, CASE WHEN predicted > 100 THEN 'above_ceiling' ELSE 'below_floor' END FROM p WHERE predicted > 100 OR predicted < 35 UNION ALL SELECT event_id, 'rate' FROM p WHERE abs(predicted - cur) > 8 * hours""")
def decision_sanity(spark, sf):
    st = v.states(spark, sf)
    label = F.element_at(F.array(*[F.lit(h) for h in ("1h", "2h", "4h", "6h")]), F.col("k") % 4 + 1)
    predictions = st.select("site_id", "event_id", F.lit("s").alias("sensor"), label.alias("horizon"), F.col("value").alias("predicted"))
    now = st.select("site_id", "event_id", F.lit("s").alias("sensor"), (40.0 + F.col("k") / 5.0).alias("temp"))
    return s.decision_sanity(predictions, now, ("site_id", "event_id")).select("event_id", "rule")
