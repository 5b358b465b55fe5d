"""Decisions, outcomes and the reports on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermofleet.decisions import backfill as b
from thermofleet.decisions import bundle as bu
from thermofleet.decisions import reports as r
from thermofleet.functions.timekeys import add_seconds
from thermofleet.harness import views as v
from thermofleet.harness.planning import cost_sql
from thermofleet.harness.registry import query
from thermofleet.operators import aggregates as agg
from thermofleet.plans.comfort import realised_cost
from thermofleet.sources import decisions as ds

AS_OF = "2024-01-25 00:00:00"


def now():
    return F.lit(AS_OF).cast("timestamp")


R = f"WITH {v.READINGS}"
H4 = "(VALUES ('1h', 60), ('2h', 120), ('4h', 240), ('6h', 360)) h(horizon, minutes)"


def _decisions(spark, sf):
    """Every purchase is a decision: it predicts `view` at four horizons and carries bounds, modes and reasons."""
    s = v.states(spark, sf).filter(F.col("name") == "purchase")
    k, x = F.col("k"), F.col("value")
    horizons = F.create_map(*[y for i, h in enumerate(b.HORIZON_MINUTES) for y in (F.lit(h), x + i)])
    full = F.create_map(*[y for n, c in {
        "min": F.lit(20.0), "max": F.lit(80.0), "preferred_lo": 30.0 + k / 10.0, "preferred_hi": 60.0 + k / 10.0,
        "acceptable_lo": F.lit(20.0), "acceptable_hi": F.lit(80.0), "cold_penalty": F.lit(2.0), "hot_penalty": F.lit(1.5)}.items() for y in (F.lit(n), c)])
    old = F.create_map(F.lit("min"), F.lit(25.0), F.lit("max"), 70.0 + k / 10.0)
    modes = [("e0", F.when(k % 2 == 0, "heating").otherwise("off")), ("fan_view", F.when(k % 3 == 0, "off").when(k % 3 == 1, "low").otherwise("high"))]
    effectors = F.array(*[
        F.struct(F.lit(n).alias("name"), m.alias("mode"), F.when(k % 5 == 0, x).alias("target"), F.lit(0).alias("delay_steps"), F.lit(None).cast("int").alias("duration_steps"))
        for n, m in modes])
    return s.select(
        "site_id", "ts", "event_id", "k", (k % 4 != 0).alias("live"), F.create_map(F.lit("view"), x).alias("current_temps"),
        F.create_map(F.lit("view"), horizons).alias("predictions"),
        F.when(k % 6 == 0, F.create_map().cast("map<string,map<string,double>>")).otherwise(F.create_map(F.lit("view"), F.when(k % 3 == 0, old).otherwise(full))).alias("comfort_bounds"),
        effectors.alias("effector_decisions"), F.create_map(F.lit("e0"), F.lit(21.0)).alias("command_targets"),
        F.when(k % 7 == 0, F.create_map(F.lit("e0"), F.lit("off"))).when(k % 11 == 0, F.create_map(F.lit("e0"), F.lit("a"), F.lit("fan_view"), F.lit("b"))).alias("blocked"),
        F.lit(False).alias("outcome_backfilled"), x.alias("comfort_cost"),
    )


def _snapshots(spark, sf):
    """Readings on five-minute-like keys: the largest value of each name per ten minutes."""
    x = v.readings(spark, sf)
    slot = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 600) * 600)
    return x.groupBy("site_id", slot.alias("ts"), "name").agg(F.max("value").alias("value"))


OUTCOMES = f"""{v.STATES}, d AS (SELECT * FROM states_v WHERE name = 'purchase'), snap AS (SELECT site_id, time_bucket(INTERVAL 10 MINUTE, ts) AS ts, name, max(value) AS value FROM states_v GROUP BY 1, 2, 3),
times AS (SELECT DISTINCT site_id, ts FROM snap),
p AS (SELECT d.site_id, d.ts AS decision_ts, d.event_id, h.horizon, d.value + CASE h.horizon WHEN '1h' THEN 0 WHEN '2h' THEN 1 WHEN '4h' THEN 2 ELSE 3 END AS predicted, d.ts + to_minutes(h.minutes) AS wanted FROM d CROSS JOIN {H4} WHERE epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(d.ts) >= (h.minutes + 5) * CAST(60000000 AS BIGINT)),
bk AS (SELECT p.*, t.ts AS bts FROM p ASOF LEFT JOIN times t ON p.site_id = t.site_id AND p.wanted >= t.ts), nx AS (SELECT bk.*, t.ts AS fts FROM bk ASOF LEFT JOIN times t ON bk.site_id = t.site_id AND bk.wanted <= t.ts),
m AS (SELECT *, CASE WHEN fts IS NULL OR epoch_us(wanted) - epoch_us(bts) <= epoch_us(fts) - epoch_us(wanted) THEN bts ELSE fts END AS sts FROM nx),
outc AS (SELECT m.site_id, m.decision_ts, m.event_id, 'view' AS sensor, m.horizon, round(m.predicted, 2) AS predicted, round(s.value, 2) AS actual, round(m.predicted - s.value, 3) AS error FROM m JOIN snap s ON s.site_id = m.site_id AND s.ts = m.sts AND s.name = 'view' WHERE abs(epoch_us(m.sts) - epoch_us(m.wanted)) <= 600000000)"""


def _outcomes(spark, sf):
    return b.match_outcomes(b.prediction_rows(b.open_decisions(_decisions(spark, sf))), _snapshots(spark, sf), now())


@query("outcome_backfill", f"WITH {OUTCOMES} SELECT site_id, epoch_us(decision_ts) AS decision_us, sensor, horizon, predicted, actual, error FROM outc")
def outcome_backfill(spark, sf):
    return _outcomes(spark, sf).select("site_id", v.us("decision_ts").alias("decision_us"), "sensor", "horizon", "predicted", "actual", "error")


@query("backfill_status", f"""WITH {OUTCOMES}, f AS (SELECT site_id, decision_ts, count(*) AS n FROM outc GROUP BY 1, 2), a AS (SELECT d.site_id, d.ts, coalesce(f.n, 0) AS n_found, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(d.ts)) / 60000000.0 AS age FROM d LEFT JOIN f ON f.site_id = d.site_id AND f.decision_ts = d.ts)
SELECT site_id, epoch_us(ts) AS decision_us, n_found, (age >= 365 AND n_found > 0) OR age > 425 AS settled, n_found > 0 OR age > 425 AS touched FROM a""")
def backfill_status(spark, sf):
    out = b.backfill_status(_decisions(spark, sf), _outcomes(spark, sf), now())
    return out.select("site_id", v.us("decision_ts").alias("decision_us"), "n_found", "settled", "touched")


@query("prediction_accuracy", f"WITH {OUTCOMES} SELECT horizon, round(avg(abs(error)), 3) AS mae, round(avg(error), 3) AS bias, count(*) AS n FROM outc GROUP BY 1")
def prediction_accuracy(spark, sf):
    return agg.accuracy_by_horizon(_outcomes(spark, sf), ["horizon"])


BOUND_COLUMNS = """CASE WHEN d.k % 3 = 0 THEN 25.0 ELSE 20.0 END AS acc_lo, CASE WHEN d.k % 3 = 0 THEN 70.0 + d.k / 10.0 ELSE 80.0 END AS acc_hi, CASE WHEN d.k % 3 = 0 THEN 25.0 ELSE 30.0 + d.k / 10.0 END AS pref_lo,
CASE WHEN d.k % 3 = 0 THEN 70.0 + d.k / 10.0 ELSE 60.0 + d.k / 10.0 END AS pref_hi, 2.0 AS cold_penalty, CASE WHEN d.k % 3 = 0 THEN 1.0 ELSE 1.5 END AS hot_penalty"""


@query("realised_cost", f"""WITH {OUTCOMES}, c AS (SELECT o.site_id, o.decision_ts, o.actual, CASE o.horizon WHEN '1h' THEN 1.0 WHEN '2h' THEN 0.9 WHEN '4h' THEN 0.7 ELSE 0.5 END AS w, {BOUND_COLUMNS} FROM outc o JOIN d ON d.event_id = o.event_id WHERE d.k % 6 <> 0)
SELECT site_id, epoch_us(decision_ts) AS decision_us, round(sum({cost_sql('actual', 'w')}), 4) AS actual_comfort_cost FROM c GROUP BY 1, 2""")
def realised_cost_query(spark, sf):
    bounds = _decisions(spark, sf).select("site_id", F.col("ts").alias("decision_ts"), F.explode("comfort_bounds").alias("label", "bounds"))
    out = realised_cost(_outcomes(spark, sf).withColumn("label", F.col("sensor")), bounds)
    return out.select("site_id", v.us("decision_ts").alias("decision_us"), "actual_comfort_cost")


def _temps(spark, sf):
    return v.readings(spark, sf).filter(F.col("name") == "view").select("site_id", F.lit("view").alias("label"), "ts", "event_id", F.col("value").alias("temp"))


BAND = f"""{v.STATES}, {v.schedules_sql()}, d AS (SELECT * FROM states_v WHERE name = 'purchase'), bd AS (SELECT site_id, ts, CASE WHEN k % 3 = 0 THEN 25.0 ELSE 20.0 END AS lo, CASE WHEN k % 3 = 0 THEN 70.0 + k / 10.0 ELSE 80.0 END AS hi, CASE WHEN k % 3 = 0 THEN 25.0 ELSE 30.0 + k / 10.0 END AS pref_lo FROM d WHERE k % 6 <> 0),
t AS (SELECT site_id, ts, event_id, value AS temp FROM states_v WHERE name = 'view'),
j AS (SELECT t.*, bd.ts AS dts, bd.lo, bd.hi, bd.pref_lo FROM t ASOF LEFT JOIN bd ON t.site_id = bd.site_id AND t.ts >= bd.ts),
band AS (SELECT j.site_id, j.ts, j.event_id, j.temp, CASE WHEN j.dts IS NOT NULL THEN j.lo ELSE h.acc_lo END AS lo, CASE WHEN j.dts IS NOT NULL THEN j.hi ELSE h.acc_hi END AS hi, CASE WHEN j.dts IS NOT NULL THEN j.pref_lo ELSE h.pref_lo END AS pref_lo FROM j LEFT JOIN hours_v h ON h.site_id = j.site_id AND h.sensor = 'view' AND h.hour = date_part('hour', j.ts))"""


@query("historic_band", f"WITH {BAND} SELECT event_id, lo, hi, pref_lo FROM band")
def historic_band(spark, sf):
    out = r.historic_band(_temps(spark, sf), r.bounds_rows(_decisions(spark, sf)), v.schedules(spark, sf))
    return out.select("event_id", "lo", "hi", "pref_lo")


def _dedicated(spark, sf):
    pairs = F.array(F.lit("e0"), F.lit("fan_view"))
    return v.sites(spark, sf).select("site_id", F.lit("view").alias("label"), F.explode(pairs).alias("effector"))


AUTHORITY = "au AS (SELECT site_id, ts, CASE WHEN k % 4 = 0 THEN 0.0 WHEN k % 7 = 0 THEN 0.5 WHEN k % 11 = 0 THEN 0.0 ELSE 1.0 END AS authority FROM states_v WHERE name = 'purchase')"


@query("control_authority", f"""WITH {v.STATES}, {AUTHORITY}, t AS (SELECT * FROM states_v WHERE name = 'view'), j AS (SELECT t.event_id, t.ts, au.ts AS dts, au.authority FROM t ASOF LEFT JOIN au ON t.site_id = au.site_id AND t.ts >= au.ts)
SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(dts) <= 7200000000 THEN authority END AS authority FROM j""")
def control_authority(spark, sf):
    rows = r.authority_rows(_decisions(spark, sf), _dedicated(spark, sf))
    return r.control_authority(_temps(spark, sf), rows, 7200).select("event_id", "authority")


@query("dedicated_effectors", f"""WITH {v.GAINS}, {v.EFFECTORS_SQL}, best AS (SELECT g.site_id, g.sensor, g.effector FROM gains_v g JOIN effectors_v e ON e.site_id = g.site_id AND e.name = g.effector WHERE e.control_type = 'trajectory' AND gain_f_per_hour > 0 QUALIFY row_number() OVER (PARTITION BY g.site_id, g.sensor ORDER BY gain_f_per_hour DESC, g.effector) = 1),
c AS (SELECT DISTINCT site_id, sensor, 'e' || (CAST(substr(sensor, 2) AS INTEGER) + 3) AS label FROM gains_v) SELECT c.site_id, c.label, best.effector FROM c JOIN best ON best.site_id = c.site_id AND best.sensor = c.sensor
UNION SELECT e.site_id, e.name, e.name FROM effectors_v e WHERE e.control_type IN ('regulating', 'binary') AND EXISTS (SELECT 1 FROM c WHERE c.site_id = e.site_id AND c.label = e.name)""")
def dedicated_effectors(spark, sf):
    g = v.gains(spark, sf)
    label = F.concat(F.lit("e"), (F.substring(F.col("sensor"), F.lit(2), F.length("sensor")).cast("int") + 3).cast("string"))
    constraints = g.select("site_id", "sensor", label.alias("label")).distinct()
    return r.dedicated_effectors(g, v.effectors(spark, sf), constraints)


def _constraints(spark, sf):
    return v.sites(spark, sf).select("site_id", F.lit("view").alias("sensor"), F.lit("view").alias("label"))


CAPACITY = """cap AS (SELECT site_id, ts, event_id, value AS temp, CASE WHEN value < CASE WHEN k % 3 = 0 THEN 25.0 ELSE 20.0 END THEN CASE WHEN k % 3 = 0 THEN 25.0 ELSE 20.0 END - value WHEN value > CASE WHEN k % 3 = 0 THEN 70.0 + k / 10.0 ELSE 80.0 END THEN CASE WHEN k % 3 = 0 THEN 70.0 + k / 10.0 ELSE 80.0 END - value ELSE 0.0 END AS violation, k % 2 = 0 AND k % 3 = 2 AS at_capacity FROM states_v WHERE name = 'purchase' AND k % 6 <> 0)"""


@query("capacity_rows", f"WITH {v.STATES}, {CAPACITY} SELECT site_id, epoch_us(ts) AS ts_us, round(violation, 6) AS violation, at_capacity FROM cap")
def capacity_rows(spark, sf):
    out = r.capacity_rows(_decisions(spark, sf), _dedicated(spark, sf), _constraints(spark, sf))
    return out.select("site_id", v.us("ts").alias("ts_us"), v.r6("violation").alias("violation"), "at_capacity")


REPORT = f"""WITH {BAND}, {AUTHORITY}, {CAPACITY}, q AS (SELECT site_id, event_id, ts, CASE WHEN temp >= 40 THEN temp END AS temp, lo, hi FROM band), ja AS (SELECT q.*, au.ts AS dts, au.authority AS a0 FROM q ASOF LEFT JOIN au ON q.site_id = au.site_id AND q.ts >= au.ts),
z AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(dts) <= 1200000000 THEN a0 END AS authority FROM ja),
s AS (SELECT site_id, coalesce(avg(CASE WHEN temp IS NOT NULL AND lo IS NOT NULL THEN CASE WHEN temp >= lo AND temp <= hi THEN 100.0 ELSE 0.0 END END), 0) AS pct_in_band, coalesce(avg(CASE WHEN temp < lo THEN lo - temp WHEN temp > hi THEN temp - hi END), 0) AS avg_violation, avg(CASE WHEN authority IS NOT NULL THEN CASE WHEN authority = 1 THEN 100.0 ELSE 0.0 END END) AS pct_controlled FROM z GROUP BY 1),
c AS (SELECT site_id, count(*) FILTER (WHERE violation > 0) AS cold_total, count(*) FILTER (WHERE violation > 0 AND at_capacity) AS cold_capacity, count(*) FILTER (WHERE violation < 0) AS hot_total FROM cap GROUP BY 1)
SELECT s.site_id, round(pct_in_band, 6) AS pct_in_band, round(avg_violation, 6) AS avg_violation, round(pct_controlled, 6) AS pct_controlled, coalesce(cold_total, 0) AS cold_total, coalesce(cold_capacity, 0) AS cold_capacity, coalesce(hot_total, 0) AS hot_total FROM s LEFT JOIN c ON c.site_id = s.site_id"""


def _report(spark, sf):
    return r.comfort_report(v.readings(spark, sf), _decisions(spark, sf), v.schedules(spark, sf), _dedicated(spark, sf), _constraints(spark, sf))


@query("comfort_report", REPORT)
def comfort_report(spark, sf):
    return _report(spark, sf).select("site_id", v.r6("pct_in_band").alias("pct_in_band"), v.r6("avg_violation").alias("avg_violation"),
                                     v.r6("pct_controlled").alias("pct_controlled"), "cold_total", "cold_capacity", "hot_total")


@query("site_summary", REPORT.replace("SELECT s.site_id, round(pct_in_band", "SELECT s.site_id, CAST(1 AS BIGINT) AS n_labels, round(pct_in_band").replace(", coalesce(cold_capacity, 0) AS cold_capacity, coalesce(hot_total, 0) AS hot_total", "").replace("round(avg_violation, 6) AS avg_violation, ", ""))
def site_summary(spark, sf):
    return r.site_summary(_report(spark, sf)).select("site_id", "n_labels", v.r6("pct_in_band").alias("pct_in_band"), v.r6("pct_controlled").alias("pct_controlled"), "cold_total")


@query("prediction_errors", f"WITH {OUTCOMES} SELECT site_id, epoch_us(decision_ts) AS decision_us, sensor AS label, horizon, error FROM outc")
def prediction_errors(spark, sf):
    from thermofleet.operators.reshape import nest_outcomes

    nested = nest_outcomes(_outcomes(spark, sf)).withColumnRenamed("decision_ts", "ts")
    return r.prediction_errors(nested).select("site_id", v.us("decision_ts").alias("decision_us"), "label", "horizon", "error")


@query("logged_vs_recomputed", f"""WITH {v.STATES}, l AS (SELECT site_id, ts, event_id, CAST(k AS DOUBLE) AS comfort_cost FROM states_v WHERE name = 'signup'), r AS (SELECT site_id, ts, value FROM states_v WHERE name = 'purchase'),
b AS (SELECT l.*, r.ts AS bts, r.value AS bv FROM l ASOF LEFT JOIN r ON l.site_id = r.site_id AND l.ts >= r.ts), n AS (SELECT b.*, r.ts AS fts, r.value AS fv FROM b ASOF LEFT JOIN r ON b.site_id = r.site_id AND b.ts <= r.ts),
c AS (SELECT *, epoch_us(ts) - epoch_us(bts) AS bg, epoch_us(fts) - epoch_us(ts) AS fg FROM n)
SELECT event_id, round(comfort_cost - CASE WHEN fts IS NULL OR bg <= fg THEN CASE WHEN bg <= 3600000000 THEN bv END ELSE CASE WHEN fg <= 3600000000 THEN fv END END, 6) AS difference FROM c""")
def logged_vs_recomputed(spark, sf):
    again = v.states(spark, sf).filter(F.col("name") == "signup").select("site_id", "ts", "event_id", F.col("k").cast("double").alias("comfort_cost"))
    return r.logged_vs_recomputed(_decisions(spark, sf), again, 3600).select("event_id", v.r6("difference").alias("difference"))


@query("status_board", f"""WITH {v.STATES}, {v.schedules_sql()}, lt AS (SELECT site_id, name, arg_max(value, (ts, event_id)) AS temp FROM states_v GROUP BY 1, 2), w AS (SELECT site_id, max(value) FILTER (WHERE name = 'error') % 60 AS outdoor FROM states_v GROUP BY 1),
b AS (SELECT lt.site_id, lt.name, lt.temp, h.acc_lo, h.acc_hi + CASE WHEN lt.site_id % 4 = 1 THEN 2.0 ELSE 0.0 END AS acc_hi, h.pref_lo, h.pref_hi, greatest(-2.0, least(2.0, 0.05 * (50 - (w.outdoor + 10.0 * 0.5 * 0.5)))) AS sh, greatest(-2.0, least(2.0, 0.05 * (50 - w.outdoor))) AS bs FROM lt JOIN hours_v h ON h.site_id = lt.site_id AND h.sensor = lt.name AND h.hour = 17 JOIN w ON w.site_id = lt.site_id),
f AS (SELECT *, CASE WHEN abs(sh) < 0.05 THEN 0.0 ELSE sh END AS shift FROM b)
SELECT site_id, name AS sensor, temp, round(acc_hi + shift, 6) AS acc_hi, round(acc_lo + shift, 6) AS acc_lo, round(pref_lo + shift, 6) AS pref_lo, round(pref_hi + shift, 6) AS pref_hi, CASE WHEN temp < acc_lo + shift THEN 'COLD' WHEN temp > acc_hi + shift THEN 'HOT' WHEN temp < pref_lo + shift THEN 'below pref' WHEN temp > pref_hi + shift THEN 'above pref' ELSE 'in band' END AS status FROM f""")
def status_board(spark, sf):
    rd = v.readings(spark, sf)
    latest = agg.latest_per_name(rd, order=F.struct("ts", "event_id"))
    sites = v.sites(spark, sf)
    weather = rd.groupBy("site_id").agg((F.max(F.when(F.col("name") == "error", F.col("value"))) % 60).alias("outdoor")).withColumns({"sun": F.lit(0.5), "fraction": F.lit(0.5)})
    solar = latest.select("site_id", F.col("name").alias("sensor"), F.lit(10.0).alias("gain"))
    zones = sites.select("site_id", F.lit("America/Phoenix").alias("zone"), now().alias("now_ts"))
    kind = F.col("site_id") % 4 == 1
    profile = sites.filter(kind).select("site_id", *[F.lit(x).alias(n) for n, x in (("preferred_offset", 0.0), ("preferred_widen", 0.0), ("min_offset", 0.0), ("max_offset", 2.0), ("penalty_scale", 1.0))])
    out = r.status_board(latest, v.schedules(spark, sf), profile, weather, solar, zones)
    return out.select("site_id", "sensor", "temp", v.r6("acc_hi").alias("acc_hi"), v.r6("acc_lo").alias("acc_lo"), v.r6("pref_lo").alias("pref_lo"), v.r6("pref_hi").alias("pref_hi"), "status")


@query("board_sections", f"""WITH {v.STATES}, lt AS (SELECT site_id, name, arg_max(value, (ts, event_id)) AS value FROM states_v WHERE name <> 'purchase' GROUP BY 1, 2),
r AS (SELECT site_id, h.h, max(ts) - INTERVAL 20 HOUR + to_hours(h.h) AS wanted FROM states_v CROSS JOIN (VALUES (1), (2), (4), (6), (12)) h(h) GROUP BY 1, 2),
c AS (SELECT r.site_id, r.h, s.value, s.k, row_number() OVER (PARTITION BY r.site_id, r.h ORDER BY abs(epoch_us(s.ts) - epoch_us(r.wanted)), s.ts) AS n FROM r JOIN states_v s ON s.site_id = r.site_id AND abs(epoch_us(s.ts) - epoch_us(r.wanted)) <= 5400000000)
SELECT site_id, 'environment' AS section, name, value, CASE WHEN value > 0.5 THEN 'active' ELSE 'default' END AS state FROM lt
UNION ALL SELECT r.site_id, 'forecast', r.h || 'h', c.value, CASE WHEN c.k IS NULL THEN NULL WHEN c.k % 2 = 0 THEN 'sunny' ELSE 'rainy' END FROM r LEFT JOIN c ON c.site_id = r.site_id AND c.h = r.h AND c.n = 1""")
def board_sections(spark, sf):
    s = v.states(spark, sf)
    latest = agg.latest_per_name(s, order=F.struct("ts", "event_id"))
    environment = s.filter(F.col("name") != "purchase").select("site_id", "name").distinct()
    refs = s.groupBy("site_id").agg(add_seconds(F.max("ts"), -20 * 3600).alias("ts"))
    forecast = s.select("site_id", F.col("ts").alias("target_ts"), F.col("value").alias("temperature"), F.when(F.col("k") % 2 == 0, "sunny").otherwise("rainy").alias("condition"))
    return r.board_sections(latest, environment, refs, forecast)


POINT = "TIMESTAMP '2024-01-20 06:00:00'"


@query("previous_state", f"""WITH {v.STATES}, p AS (SELECT site_id, arg_max(event_id, ts) AS event_id FROM states_v WHERE name = 'purchase' AND ts < {POINT} GROUP BY 1)
SELECT s.site_id, epoch_us(s.ts) AS last_us, CASE WHEN k % 2 = 0 THEN 'heating' ELSE 'off' END AS e0_mode, CASE WHEN k % 5 = 0 THEN value ELSE 21.0 END AS e0_setpoint, CASE WHEN k % 5 = 0 THEN value END AS fan_setpoint FROM states_v s JOIN p ON p.event_id = s.event_id""")
def previous_state(spark, sf):
    before = bu.decision_before(_decisions(spark, sf), F.lit("2024-01-20 06:00:00").cast("timestamp"), strict=True)
    out = bu.previous_state(before)
    return out.select("site_id", v.us("last_decision_ts").alias("last_us"), F.col("modes")["e0"].alias("e0_mode"), F.col("setpoints")["e0"].alias("e0_setpoint"),
                      F.try_element_at("setpoints", F.lit("fan_view")).alias("fan_setpoint"))


@query("site_bundle", f"""WITH {v.READINGS}, d AS (SELECT * FROM readings_v WHERE name = 'purchase'),
a AS (SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY site_id ORDER BY ts DESC) AS n FROM d WHERE ts <= {POINT}) WHERE n <= 5 UNION ALL SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS n FROM d WHERE ts > {POINT}) WHERE n <= 2)
SELECT 'readings' AS part, event_id FROM readings_v WHERE ts >= {POINT} - INTERVAL 14 HOUR AND ts <= {POINT} UNION ALL SELECT 'around', event_id FROM a UNION ALL SELECT 'decision', arg_max(event_id, ts) FROM d WHERE ts <= {POINT} GROUP BY site_id""")
def site_bundle(spark, sf):
    parts = bu.bundle(v.readings(spark, sf), _decisions(spark, sf), F.lit("2024-01-20 06:00:00").cast("timestamp"))
    rows = [parts[p].select(F.lit(p).alias("part"), "event_id") for p in ("readings", "around", "decision")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("site_bundles", f"""WITH {v.READINGS}, t AS (SELECT DISTINCT site_id, ts AS target FROM readings_v WHERE name = 'error'), d AS (SELECT * FROM readings_v WHERE name = 'purchase'),
a AS (SELECT t.site_id, t.target, d.event_id, d.ts <= t.target AS past, row_number() OVER (PARTITION BY t.site_id, t.target, d.ts <= t.target ORDER BY abs(epoch_us(d.ts) - epoch_us(t.target))) AS n FROM t JOIN d ON d.site_id = t.site_id)
SELECT 'readings' AS part, t.site_id, epoch_us(target) AS target_us, event_id FROM t JOIN readings_v r ON r.site_id = t.site_id AND r.ts >= t.target - INTERVAL 14 HOUR AND r.ts <= t.target
UNION ALL SELECT 'around', site_id, epoch_us(target), event_id FROM a WHERE (past AND n <= 5) OR (NOT past AND n <= 2)
UNION ALL SELECT 'decision', site_id, epoch_us(target), event_id FROM a WHERE past AND n = 1
UNION ALL SELECT 'previous_state', site_id, epoch_us(target), epoch_us(last) FROM (SELECT t.site_id, t.target, max(d.ts) AS last FROM t JOIN d ON d.site_id = t.site_id AND d.ts < t.target GROUP BY 1, 2)""")
def site_bundles(spark, sf):
    """Bundles of every error's moment, all sites at once."""
    r = v.readings(spark, sf)
    targets = r.filter(F.col("name") == "error").select("site_id", F.col("ts").alias("target_ts"))
    parts = bu.bundles(targets, r, _decisions(spark, sf))
    ids = {p: df.select(F.lit(p).alias("part"), "site_id", v.us("target_ts").alias("target_us"), (v.us("last_decision_ts") if p == "previous_state" else F.col("event_id")).alias("event_id")) for p, df in parts.items()}
    return ids["readings"].unionByName(ids["around"]).unionByName(ids["decision"]).unionByName(ids["previous_state"])


@query("decision_rows", f"WITH {v.STATES} SELECT event_id, CASE WHEN k % 7 = 0 OR k % 11 = 0 OR k % 10 = 0 THEN true ELSE false END AS blocked, CASE WHEN abs((k - 50) / 100.0) >= 0.05 THEN round((k - 50) / 100.0 * 2, 3) END AS offset_view, CASE WHEN k % 10 = 0 THEN 'ineligible' END AS e9_reason FROM states_v WHERE name = 'purchase'")
def decision_rows(spark, sf):
    d = _decisions(spark, sf)
    k = F.col("k")
    ineligible = F.when(k % 10 == 0, F.create_map(F.lit("e9"), F.lit("ineligible")))
    built = d.withColumns({
        "blocked": ds.merged_reasons(ineligible, F.col("blocked")),
        "mrt_offsets": ds.radiant_offsets(F.create_map(F.lit("view"), F.lit(2.0)), (k - 50) / 100.0),
    })
    landed = ds.decision_rows(built)
    back = landed.select("event_id", F.from_json("blocked", "map<string,string>").alias("b"), F.from_json("mrt_offsets", "map<string,double>").alias("m"))
    return back.select("event_id", F.col("b").isNotNull().alias("blocked"), F.try_element_at("m", F.lit("view")).alias("offset_view"), F.try_element_at("b", F.lit("e9")).alias("e9_reason"))


@query("bounds_map", f"WITH {v.READINGS}, {v.schedules_sql()} SELECT r.event_id, count(*) AS n_labels, max(h.acc_hi) AS top FROM readings_v r JOIN hours_v h ON h.site_id = r.site_id AND h.hour = date_part('hour', r.ts) WHERE r.name = 'purchase' GROUP BY 1")
def bounds_map(spark, sf):
    from thermofleet.operators.lookup import hourly_schedule

    d = v.readings(spark, sf).filter(F.col("name") == "purchase").select("site_id", "event_id", F.hour("ts").alias("hour"))
    entries = d.join(hourly_schedule(v.schedules(spark, sf)), ["site_id", "hour"])
    out = ds.bounds_map(entries, ("site_id", "event_id"))
    return out.select("event_id", F.size("comfort_bounds").cast("bigint").alias("n_labels"), F.array_max(F.transform(F.map_values("comfort_bounds"), lambda m: m["max"])).alias("top"))
