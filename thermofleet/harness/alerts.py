"""Health, cooldown, override, freshness and eligibility rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermofleet.harness import views as v
from thermofleet.harness.registry import query
from thermofleet.operators.aggregates import status
from thermofleet.rules import cooldown as cd
from thermofleet.rules import health as h
from thermofleet.rules import overrides as ov

AS_OF = "2024-01-20 12:00:00"


def now():
    return F.lit(AS_OF).cast("timestamp")


NOW_US = f"epoch_us(TIMESTAMP '{AS_OF}')"

CHECK_NAMES = ["name", "entity_id", "min_value", "max_value", "expected_state", "severity", "message", "when_entity", "when_state", "when_for_minutes", "sustain_minutes", "sustain_samples"]
CHECKS = [
    ("low_view", "view", 30.0, None, None, "critical", "", None, None, 0, 0, 0),
    ("high_click", "click", None, 45.0, None, "warning", "too high", "view", "on", 60, 0, 0),
    ("mode_error", "error", None, None, "ok", "critical", "", None, None, 0, 0, 0),
    ("range_signup", "signup", 10.0, 60.0, None, "warning", "", "purchase", "on", 0, 240, 60),
    ("range_purchase", "purchase", 20.0, 70.0, None, "warning", "", None, None, 0, 600, 200),
]
CHECK_TYPES = "name string, entity_id string, min_value double, max_value double, expected_state string, severity string, message string, when_entity string, when_state string, when_for_minutes int, sustain_minutes int, sustain_samples int"
CHECK_SQL = f"checks_v AS (SELECT s.site_id, c.name, c.entity_id, CAST(c.min_value AS DOUBLE) AS min_value, CAST(c.max_value AS DOUBLE) AS max_value, CAST(c.expected_state AS VARCHAR) AS expected_state, c.severity, c.message, CAST(c.when_entity AS VARCHAR) AS when_entity, CAST(c.when_state AS VARCHAR) AS when_state, c.when_for_minutes, c.sustain_minutes, c.sustain_samples FROM sites_v s CROSS JOIN (VALUES {v.values_sql(CHECKS)}) c({', '.join(CHECK_NAMES)}))"


def _checks(spark, sf):
    names = [t.split(" ")[0] for t in CHECK_TYPES.split(", ")]
    types = [t.split(" ")[1] for t in CHECK_TYPES.split(", ")]
    rows = F.array(*[F.struct(*[F.lit(x).cast(t).alias(n) for n, t, x in zip(names, types, c)]) for c in CHECKS])
    return v.sites(spark, sf).withColumn("c", F.explode(rows)).select("site_id", "c.*")


def _now_states(spark, sf):
    """Latest state of every entity before the moment; `view` and `purchase` also serve as on/off switches."""
    s = v.states(spark, sf).filter(F.col("ts") <= now())
    last = s.groupBy("site_id", F.col("name").alias("entity_id")).agg(F.max_by(F.struct("value", "k", "ts"), F.struct("ts", "event_id")).alias("x"))
    state = F.when(F.col("x.k") % 9 == 0, "unavailable").when(F.col("entity_id") == "error", F.when(F.col("x.k") % 2 == 0, "ok").otherwise("bad")).otherwise(F.col("x.value").cast("string"))
    numbers = last.select("site_id", "entity_id", state.alias("state"), F.col("x.ts").alias("last_changed"))
    return numbers, last.select("site_id", "entity_id", F.when(F.col("x.k") % 4 == 0, "off").otherwise("on").alias("state"), F.col("x.ts").alias("last_changed"))


ALERTS = f"""WITH {v.STATES}, {v.SITES}, {CHECK_SQL}, lt AS (SELECT site_id, name AS entity_id, arg_max(value, ts) AS value, arg_max(k, ts) AS k, max(ts) AS ts FROM states_v WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2),
st AS (SELECT site_id, entity_id, k, ts, CASE WHEN k % 9 = 0 THEN 'unavailable' WHEN entity_id = 'error' THEN CASE WHEN k % 2 = 0 THEN 'ok' ELSE 'bad' END ELSE 'n' END AS state, value FROM lt),
ac AS (SELECT c.* FROM checks_v c LEFT JOIN lt w ON w.site_id = c.site_id AND w.entity_id = c.when_entity WHERE c.when_entity IS NULL OR (CASE WHEN w.k % 4 = 0 THEN 'off' ELSE 'on' END = c.when_state AND w.k IS NOT NULL AND (c.when_for_minutes = 0 OR {NOW_US} - epoch_us(w.ts) >= c.when_for_minutes * CAST(60000000 AS BIGINT)))),
sm AS (SELECT c.site_id, c.name, c.entity_id, c.min_value, c.max_value, make_timestamp({NOW_US} - c.sustain_minutes * CAST(60000000 AS BIGINT) + i.i * CAST(60000000 AS BIGINT) + 30000000) AS ts FROM checks_v c, LATERAL (SELECT unnest(range(c.sustain_minutes)) AS i) i WHERE c.sustain_minutes > 0),
hs AS (SELECT site_id, name AS entity_id, ts, value FROM states_v WHERE k % 9 <> 0), sv AS (SELECT sm.*, hs.value FROM sm ASOF LEFT JOIN hs ON sm.site_id = hs.site_id AND sm.entity_id = hs.entity_id AND sm.ts >= hs.ts),
n AS (SELECT site_id, name, count(*) FILTER (WHERE coalesce(value <= min_value, false) OR coalesce(value >= max_value, false)) AS n_violating FROM sv GROUP BY 1, 2)"""


@query("sustained_violation", ALERTS + " SELECT site_id, name, n_violating FROM n")
def sustained_violation(spark, sf):
    return h.sustained_counts(_checks(spark, sf), _history(spark, sf), now())


def _history(spark, sf):
    s = v.states(spark, sf)
    state = F.when(F.col("k") % 9 == 0, "unavailable").otherwise(F.col("value").cast("string"))
    return s.select("site_id", F.col("name").alias("entity_id"), F.col("ts").alias("changed_at"), state.alias("state"))


@query("health_alerts", ALERTS + """, j AS (SELECT ac.*, st.state, st.value, coalesce(n.n_violating, 0) AS nv FROM ac JOIN st ON st.site_id = ac.site_id AND st.entity_id = ac.entity_id LEFT JOIN n ON n.site_id = ac.site_id AND n.name = ac.name),
k2 AS (SELECT *, CASE WHEN state = 'unavailable' THEN 'unavailable' WHEN expected_state IS NOT NULL THEN CASE WHEN state <> expected_state THEN 'fault' END WHEN (coalesce(value <= min_value, false) OR coalesce(value >= max_value, false)) AND (sustain_minutes <= 0 OR sustain_samples <= 0 OR nv >= sustain_samples) THEN 'fault' END AS kind FROM j)
SELECT site_id, name, name || '_' || kind AS "key", kind, CASE WHEN kind = 'unavailable' THEN 'warning' ELSE severity END AS severity FROM k2 WHERE kind IS NOT NULL""")
def health_alerts(spark, sf):
    numbers, switches = _now_states(spark, sf)
    checks = h.precondition_met(_checks(spark, sf), switches, now()).withColumns({"when_entity": F.lit(None).cast("string")})
    return h.health_alerts(checks, numbers, now(), _history(spark, sf)).select("site_id", "name", "key", "kind", "severity")


@query("precondition_dwell", ALERTS + " SELECT site_id, name FROM ac")
def precondition_dwell(spark, sf):
    return h.precondition_met(_checks(spark, sf), _now_states(spark, sf)[1], now()).select("site_id", "name")


@query("heat_wanted_but_off", f"WITH {v.PLAN_OPTIONS}, {v.EFFECTORS_SQL} SELECT DISTINCT p.site_id, p.plan_id, p.effector, p.effector || '_off' AS \"key\" FROM plan_options_v p JOIN effectors_v e ON e.site_id = p.site_id AND e.name = p.effector WHERE e.control_type = 'trajectory' AND p.mode <> 'off' AND p.plan_id % 3 = 0")
def heat_wanted_but_off(spark, sf):
    p = v.plan_options(spark, sf)
    # a plan stands for one cycle of its site, so the pair (site, plan) is the site key here
    cycle = F.col("site_id") * 1_000_000_000 + F.col("plan_id")
    decisions = p.select(cycle.alias("site_id"), "effector", "mode")
    effectors = v.effectors(spark, sf).join(p.select("site_id", "plan_id").distinct(), ["site_id"]).withColumn("site_id", cycle)
    actions = p.select(cycle.alias("site_id"), "effector", F.when(F.col("plan_id") % 3 == 0, "off").otherwise("heating").alias("action"))
    out = h.heat_wanted_but_off(decisions, effectors, actions)
    return out.select(F.floor(F.col("site_id") / 1_000_000_000).alias("site_id"), (F.col("site_id") % 1_000_000_000).alias("plan_id"), "effector", "key")


@query("freshness", f"WITH {v.READINGS}, s AS (SELECT site_id, name, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts))) / CAST(60000000.0 AS DOUBLE) AS age FROM readings_v GROUP BY 1, 2) SELECT site_id, name, round(age, 4) AS age_minutes, age > 180 AS stale FROM s")
def freshness(spark, sf):
    out = h.freshness(status(v.readings(spark, sf), ["site_id", "name"]), F.lit("2024-01-31").cast("timestamp"), 180.0)
    return out.select("site_id", "name", F.round("age_minutes", 4).alias("age_minutes"), "stale")


@query("ineligible_effectors", f"""WITH {v.PLAN_OPTIONS}, {v.EFFECTORS_SQL}, p AS (SELECT site_id, effector, max(plan_id * 7 + option_no) AS x FROM plan_options_v GROUP BY 1, 2)
SELECT e.site_id, e.name AS effector, CASE WHEN p.x % 3 = 0 THEN 'hvac_mode is off' WHEN p.x % 3 = 1 THEN 'boiler is unavailable' ELSE 'boiler is unreachable' END AS reason FROM effectors_v e JOIN p ON p.site_id = e.site_id AND p.effector = e.name WHERE e.control_type = 'trajectory' AND (p.x % 3 <> 2 OR e.site_id % 2 = 0)""")
def ineligible_effectors(spark, sf):
    x = v.plan_options(spark, sf).groupBy("site_id", F.col("effector").alias("name")).agg(F.max(F.col("plan_id") * 7 + F.col("option_no")).alias("x"))
    e = v.effectors(spark, sf).join(x, ["site_id", "name"]).withColumns({"entity_id": F.col("name"), "state_device": F.when((F.col("x") % 3 != 2) | (F.col("site_id") % 2 == 0), F.lit("boiler"))})
    states = e.select("site_id", "entity_id", F.when(F.col("x") % 3 == 0, "off").otherwise("heat").alias("state"))
    gates = e.filter((F.col("x") % 3 == 1)).select("site_id", F.col("name").alias("g")).distinct()
    # one gate device per effector: its name carries the effector
    e = e.withColumn("state_device", F.when(F.col("state_device").isNotNull(), F.concat(F.lit("boiler:"), F.col("name"))))
    gate_states = gates.select("site_id", F.concat(F.lit("boiler:"), F.col("g")).alias("state_device"), F.lit("unavailable").alias("state"))
    out = h.ineligible_effectors(e, states, gate_states)
    return out.select("site_id", "effector", F.regexp_replace("reason", "boiler:[^ ]*", "boiler").alias("reason"))


@query("cooldown_scan", f"""WITH RECURSIVE {v.READINGS}, a AS (SELECT x.site_id, x.name, x.ts, min(y.ts) AS lead_ts FROM readings_v x JOIN readings_v y ON x.site_id = y.site_id AND x.name = y.name AND y.ts >= x.ts + INTERVAL 6 HOUR GROUP BY 1, 2, 3),
s AS (SELECT site_id, name, min(ts) AS ts FROM readings_v GROUP BY 1, 2 UNION ALL SELECT a.site_id, a.name, a.lead_ts FROM s JOIN a ON a.site_id = s.site_id AND a.name = s.name AND a.ts = s.ts WHERE a.lead_ts IS NOT NULL)
SELECT site_id, name, epoch_us(ts) AS ts_us FROM s""")
def cooldown_scan(spark, sf):
    alerts = v.readings(spark, sf).select("site_id", "name", F.col("ts").alias("raised_at"), "event_id")
    out = cd.cooldown_scan(alerts, ["site_id", "name"], 6 * 3600)
    return out.filter("sent").select("site_id", "name", v.us("raised_at").alias("ts_us"))


GATE = f"""WITH {v.STATES}, f AS (SELECT event_id AS site_id, name AS device, -value / 30.0 AS cost_delta, k FROM states_v), g AS (SELECT * FROM f WHERE -cost_delta >= 1.5 AND (k % 24 >= 7 AND k % 24 < 22) AND NOT (k % 3 = 0 AND k * 600 < 14400))"""


def _found(spark, sf):
    s = v.states(spark, sf)
    return s.select(F.col("event_id").alias("site_id"), F.col("name").alias("device"), F.lit("open").alias("action"), (-F.col("value") / 30.0).alias("cost_delta"), "k")


def _announce(spark, sf):
    f = _found(spark, sf)
    sent = f.filter(F.col("k") % 3 == 0).select("site_id", "device", F.timestamp_micros(F.unix_micros(now()) - F.col("k").cast("bigint") * 600 * 1_000_000).alias("sent_at"))
    return f, cd.notification_gate(f, F.col("k") % 24, sent, now())


@query("notification_gate", GATE + " SELECT site_id, device, round(cost_delta, 6) AS cost_delta FROM g")
def notification_gate(spark, sf):
    return _announce(spark, sf)[1].select("site_id", "device", v.r6("cost_delta").alias("cost_delta"))


@query("rollup_notice", GATE + ", x AS (SELECT site_id // 8 AS site_id, count(*) AS n FROM g GROUP BY 1) SELECT site_id, 'notify' AS event, n AS n_items FROM x UNION ALL SELECT DISTINCT site_id // 8, 'dismiss', CAST(0 AS BIGINT) FROM f WHERE NOT EXISTS (SELECT 1 FROM f f2 WHERE f2.site_id // 8 = f.site_id // 8 AND f2.cost_delta < -4)")
def rollup_notice(spark, sf):
    f, announce = _announce(spark, sf)
    by = F.floor(F.col("site_id") / 8).alias("site_id")
    out = cd.rollup(announce.select(by, "device", "action", "cost_delta"), f.select(by), f.filter(F.col("cost_delta") < -4).select(by))
    return out.select("site_id", "event", "n_items")


@query("override_class", f"""WITH {v.STATES}, d AS (SELECT event_id, name, k, value, CASE name WHEN 'view' THEN 'trajectory' WHEN 'click' THEN 'trajectory' WHEN 'error' THEN 'regulating' ELSE 'binary' END AS ct,
CASE WHEN k % 13 = 0 THEN NULL ELSE ['off', 'heat', 'cool'][k % 3 + 1] END AS mode, CASE WHEN k % 17 = 0 THEN NULL ELSE round(value) END AS target, ['off', 'heat'][k % 2 + 1] AS sm, value AS st, CASE WHEN k % 5 <> 0 THEN ['off', 'heat', 'cool'][k % 4 % 3 + 1] END AS lm, CASE WHEN k % 5 <> 0 THEN value + k % 3 - 1 END AS lt FROM states_v),
e AS (SELECT *, CASE WHEN ct = 'trajectory' THEN target IS NULL ELSE mode IS NULL END AS missing, coalesce(abs(st - target) < 0.5, false) AS near FROM d)
SELECT event_id, CASE WHEN missing THEN 'ineligible' WHEN CASE ct WHEN 'trajectory' THEN near WHEN 'regulating' THEN sm = mode AND (mode = 'off' OR near) ELSE sm = mode END THEN 'already_correct'
WHEN CASE WHEN ct = 'trajectory' THEN coalesce(abs(st - lt) > 0.5, false) ELSE lm IS NOT NULL AND sm <> lm END THEN 'override' ELSE 'applied' END AS result FROM e""")
def override_class(spark, sf):
    s = v.states(spark, sf)
    k, x = F.col("k"), F.col("value")
    kind = F.when(F.col("name").isin("view", "click"), "trajectory").when(F.col("name") == "error", "regulating").otherwise("binary")
    modes = F.array(F.lit("off"), F.lit("heat"), F.lit("cool"))
    base = s.select(F.col("event_id").alias("site_id"), F.col("name").alias("device"), "k", "value", kind.alias("control_type"))
    desired = base.select("site_id", "device", "control_type", F.when(k % 13 != 0, F.element_at(modes, k % 3 + 1)).alias("mode"), F.when(k % 17 != 0, F.round(x)).alias("target"))
    observed = base.select("site_id", "device", F.element_at(modes, k % 2 + 1).alias("mode"), x.alias("target"))
    age = F.when(k % 5 == 0, 3600).otherwise(600).cast("bigint")
    applied = base.select("site_id", "device", F.element_at(modes, k % 4 % 3 + 1).alias("mode"), (x + k % 3 - 1).alias("target"), F.timestamp_micros(F.unix_micros(now()) - age * 1_000_000).alias("at"))
    return ov.classify_devices(desired, observed, applied, now()).select(F.col("site_id").alias("event_id"), "result")
