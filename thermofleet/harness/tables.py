"""Sources, reshaping, lookups and aggregate reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermofleet.functions import labels as lb
from thermofleet.functions.timekeys import hour_in_window
from thermofleet.harness import views as v
from thermofleet.harness.registry import query
from thermofleet.operators import aggregates as agg
from thermofleet.operators import lookup as lk
from thermofleet.operators import reshape as rs
from thermofleet.operators import spans as sp
from thermofleet.operators.track import Track
from thermofleet.sources import states as st
from thermofleet.sources.decisions import parse_decisions
from thermofleet.sources.forecast import forecast_rows
from thermofleet.sources.params import usable_gains
from thermofleet.sources.readings import names_like
from thermofleet.sources.runs import run_history, run_targets

R = f"WITH {v.READINGS} "


# ── scans and filters ──────────────────────────────────────────────────────
@query("status", R + "SELECT site_id, epoch_us(max(ts)) AS latest_us, count(*) AS n_rows FROM readings_v GROUP BY 1")
def status(spark, sf):
    return agg.status(v.readings(spark, sf)).select("site_id", v.us("latest_ts").alias("latest_us"), "n_rows")


@query("table_stats", R + "SELECT site_id, count(DISTINCT date_trunc('hour', ts)) AS n_timestamps, count(DISTINCT name) AS n_names, epoch_us(date_trunc('hour', min(ts))) AS first_us, count(*) AS n_rows FROM readings_v GROUP BY 1")
def table_stats(spark, sf):
    out = agg.table_stats(v.readings(spark, sf).withColumn("ts", F.date_trunc("hour", "ts")))
    return out.select("site_id", "n_timestamps", "n_names", v.us("first_ts").alias("first_us"), "n_rows")


@query("latest_snapshot", R + "SELECT r.site_id, name, event_id FROM readings_v r JOIN (SELECT site_id, max(date_trunc('hour', ts)) AS h FROM readings_v GROUP BY 1) m ON r.site_id = m.site_id AND date_trunc('hour', r.ts) = m.h")
def latest_snapshot(spark, sf):
    hours = v.readings(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    return agg.latest_snapshot(hours).select("site_id", "name", "event_id")


@query("latest_per_name", R + "SELECT site_id, name, arg_max(value, ts) AS value, epoch_us(max(ts)) AS ts_us, arg_max(value, ts) > 40 AS active FROM readings_v GROUP BY 1, 2")
def latest_per_name(spark, sf):
    out = agg.latest_per_name(v.readings(spark, sf), order=F.struct("ts", "event_id"), active_above=40)
    return out.select("site_id", "name", "value", v.us("ts").alias("ts_us"), "active")


@query("name_filter", R + "SELECT name, count(*) AS n FROM readings_v WHERE name LIKE '%r%' AND contains(lower(name), lower('ER')) GROUP BY 1")
def name_filter(spark, sf):
    return names_like(v.readings(spark, sf), "%r%", "ER").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("typed_coercion", R + ", t AS (SELECT event_id, CASE WHEN name = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS real_col, CAST(event_id AS VARCHAR) AS int_col FROM readings_v) SELECT event_id, TRY_CAST(real_col AS DOUBLE) AS real_col, TRY_CAST(int_col AS INTEGER) AS int_col FROM t")
def typed_coercion(spark, sf):
    text = F.when(F.col("name") == "error", "n/a").otherwise(F.col("value").cast("string"))
    rows = v.readings(spark, sf).select("event_id", text.alias("real_col"), F.col("event_id").cast("string").alias("int_col"))
    return rs.coerce(rows, {"real_col": "REAL", "int_col": "INTEGER"})


@query("plausibility", R + "SELECT event_id, CASE WHEN value >= 40 AND value <= 100 THEN value END AS value, CASE WHEN name = 'error' THEN true WHEN name = 'view' THEN value >= 5 AND value <= 38 ELSE value >= 40 AND value <= 100 END AS plausible FROM readings_v")
def plausibility(spark, sf):
    r = v.readings(spark, sf)
    text = F.when(F.col("name") == "error", "n/a").otherwise(F.col("value").cast("string"))
    unit = F.when(F.col("name") == "view", "°C").otherwise("°F")
    return r.select("event_id", rs.null_if_implausible(F.col("value"), 40, 100).alias("value"), rs.plausible_room_temperature(text, unit).alias("plausible"))


@query("sensor_labels", "SELECT p_partkey, replace(p_name, ' ', '_') AS label, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '_') || '_x' END AS label2 FROM part")
def sensor_labels(spark, sf):
    p = v.table(spark, sf, "part")
    base = F.regexp_replace("p_name", " ", "_")
    full = F.concat(F.lit("thermostat_"), base, F.when(F.col("p_size") % 2 == 0, "_temp").otherwise("_x"))
    return p.select("p_partkey", lb.sensor_label(F.concat(F.lit("thermostat_"), base, F.lit("_temp"))).alias("label"), lb.sensor_label(full).alias("label2"))


@query("target_parse", "WITH t AS (SELECT p_partkey, lower(p_type) AS room, p_size, CASE WHEN p_size % 5 = 0 THEN lower(p_type) ELSE lower(p_type) || '_temp_t+' || p_size END AS target FROM part) SELECT p_partkey, room, CASE WHEN p_size % 5 = 0 THEN '' ELSE CASE p_size WHEN 1 THEN '1h' WHEN 2 THEN '2h' WHEN 3 THEN '3h' WHEN 4 THEN '4h' WHEN 6 THEN '6h' WHEN 12 THEN '12h' WHEN 24 THEN '2h' WHEN 48 THEN '4h' WHEN 72 THEN '6h' WHEN 144 THEN '12h' ELSE 't+' || p_size END END AS horizon FROM t")
def target_parse(spark, sf):
    p = v.table(spark, sf, "part")
    target = F.when(F.col("p_size") % 5 == 0, F.lower("p_type")).otherwise(F.concat(F.lower("p_type"), F.lit("_temp_t+"), F.col("p_size").cast("string")))
    room, horizon = lb.parse_target(target)
    return p.select("p_partkey", room.alias("room"), horizon.alias("horizon"))


ENTITY = """e AS (SELECT c_custkey, ['climate', 'fan', 'sensor', 'binary_sensor', 'weather', 'light'][c_nationkey % 6 + 1] || '.' || lower(c_mktsegment) || ['_air_temperature', '_temperature', '_humidity', '_contact'][c_custkey % 4 + 1] AS entity_id,
['temperature', 'humidity', '', 'window', 'door', 'power'][c_custkey % 6 + 1] AS device_class, ['°F', '%', '', 'W'][c_custkey % 4 + 1] AS unit,
CASE WHEN c_custkey % 3 = 0 THEN ['heat', 'off'] ELSE ['heat', 'cool', 'off'] END AS hvac_modes, CASE WHEN c_custkey % 11 = 0 THEN 'unavailable' ELSE 'on' END AS state FROM customer)"""


def _entities(spark, sf):
    c = v.table(spark, sf, "customer")

    def pick(items, index):
        return F.element_at(F.array(*[F.lit(i) for i in items]), (index + 1).cast("int"))

    key = F.col("c_custkey")
    domain = pick(["climate", "fan", "sensor", "binary_sensor", "weather", "light"], F.col("c_nationkey") % 6)
    tail = pick(["_air_temperature", "_temperature", "_humidity", "_contact"], key % 4)
    return c.select(
        "c_custkey", F.concat(domain, F.lit("."), F.lower("c_mktsegment"), tail).alias("entity_id"),
        pick(["temperature", "humidity", "", "window", "door", "power"], key % 6).alias("device_class"),
        pick(["°F", "%", "", "W"], key % 4).alias("unit"),
        F.when(key % 3 == 0, F.array(F.lit("heat"), F.lit("off"))).otherwise(F.array(F.lit("heat"), F.lit("cool"), F.lit("off"))).alias("hvac_modes"),
        F.when(key % 11 == 0, "unavailable").otherwise("on").alias("state"),
    )


@query("classify_entities", f"""WITH {ENTITY}, d AS (SELECT *, split_part(entity_id, '.', 1) AS domain FROM e WHERE state <> 'unavailable')
SELECT c_custkey, domain, CASE domain WHEN 'climate' THEN CASE WHEN list_contains(hvac_modes, 'cool') THEN 'mini_split' ELSE 'thermostat' END
WHEN 'fan' THEN 'fan' WHEN 'weather' THEN 'weather'
WHEN 'sensor' THEN CASE WHEN device_class = 'temperature' OR unit = '°F' THEN 'temperature' WHEN device_class = 'humidity' THEN 'humidity' WHEN unit = '%' THEN NULL WHEN device_class = 'power' THEN 'power' END
WHEN 'binary_sensor' THEN CASE device_class WHEN 'window' THEN 'window' WHEN 'door' THEN 'door' END END AS role FROM d""")
def classify_entities(spark, sf):
    return st.classify_entities(_entities(spark, sf)).select("c_custkey", "domain", "role")


@query("clean_names", f"""WITH {ENTITY}, b AS (SELECT c_custkey, split_part(entity_id, '.', 2) AS n FROM e)
SELECT c_custkey, CASE WHEN n LIKE '%\\_air\\_temperature' ESCAPE '\\' THEN left(n, length(n) - 16) WHEN n LIKE '%\\_temperature' ESCAPE '\\' THEN left(n, length(n) - 12) ELSE n END || '_temp' AS temp_name,
CASE WHEN n LIKE '%\\_humidity' ESCAPE '\\' THEN n ELSE n || '_humidity' END AS humidity_name, CASE WHEN n LIKE '%\\_contact' ESCAPE '\\' THEN left(n, length(n) - 8) ELSE n END AS opening_name FROM b""")
def clean_names(spark, sf):
    e = _entities(spark, sf)
    i = F.col("entity_id")
    return e.select("c_custkey", lb.temperature_name(i).alias("temp_name"), lb.humidity_name(i).alias("humidity_name"), lb.opening_name(i).alias("opening_name"))


# ── entity states ──────────────────────────────────────────────────────────
def _entity_states(spark, sf):
    s = v.states(spark, sf)
    k = F.col("k").cast("string")
    attributes = (
        F.when(F.col("name") == "purchase", F.create_map(F.lit("current_temperature"), F.col("value").cast("string"), F.lit("temperature"), k))
        .when(F.col("name") == "error", F.create_map(F.lit("current_position"), k))
        .when((F.col("name") == "signup") & (F.col("k") % 3 == 0), F.create_map(F.lit("preset_mode"), F.lit("high")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    state = (
        F.when(F.col("name") == "view", F.when(F.col("k") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")))
        .when(F.col("name") == "purchase", "heat")
        .when(F.col("name") == "signup", F.when(F.col("k") % 2 == 0, "off").otherwise("on"))
        .otherwise(F.when(F.col("k") % 2 == 0, "on").otherwise("off"))
    )
    return s.select(
        "site_id", F.concat(F.lit("x."), F.col("name")).alias("entity_id"), state.alias("state"), attributes.alias("attributes"),
        F.col("ts").alias("last_changed"), F.col("ts").alias("last_updated"),
    )


def _dims(spark, sf):
    kinds = [("view", "numeric", None, None), ("click", "binary", "on", None), ("purchase", "climate", None, "manual"),
             ("error", "cover", "closed", None), ("signup", "fan", None, None)]
    items = F.array(*[
        F.struct(F.lit(f"x.{n}").alias("entity_id"), F.lit(k).alias("kind"), F.lit(n).alias("name"), F.lit(act).cast("string").alias("active_state"),
                 F.lit(m).cast("string").alias("mode_control"), F.lit(False).alias("has_command"))
        for n, k, act, m in kinds
    ])
    return v.sites(spark, sf).withColumn("d", F.explode(items)).select("site_id", "d.*")


@query("states_to_readings", f"""WITH {v.STATES} SELECT site_id, epoch_us(ts) AS ts_us, 'view' AS name, CASE WHEN k % 7 <> 0 THEN value END AS number, NULL AS word FROM states_v WHERE name = 'view'
UNION ALL SELECT site_id, epoch_us(ts), 'click', CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END, NULL FROM states_v WHERE name = 'click'
UNION ALL SELECT site_id, epoch_us(ts), 'purchase_temp', value, NULL FROM states_v WHERE name = 'purchase'
UNION ALL SELECT site_id, epoch_us(ts), 'purchase_target', CAST(k AS DOUBLE), NULL FROM states_v WHERE name = 'purchase'
UNION ALL SELECT site_id, epoch_us(ts), 'purchase_action', NULL, 'idle' FROM states_v WHERE name = 'purchase'
UNION ALL SELECT site_id, epoch_us(ts), 'error', round(1.0 - k / 100.0, 2), NULL FROM states_v WHERE name = 'error'
UNION ALL SELECT site_id, epoch_us(ts), 'signup_mode', NULL, CASE WHEN k % 2 = 0 THEN 'off' WHEN k % 3 = 0 THEN 'high' ELSE 'low' END FROM states_v WHERE name = 'signup'""")
def states_to_readings(spark, sf):
    out = st.states_to_readings(_entity_states(spark, sf), _dims(spark, sf))
    number = F.col("value").try_cast("double")
    return out.select("site_id", v.us("ts").alias("ts_us"), "name", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("word"))


@query("states_complete", f"""WITH {v.STATES}, polls AS (SELECT DISTINCT site_id, ts FROM states_v), names AS (SELECT * FROM (VALUES ('view', 'view', '0.0'), ('click', 'click', '0'), ('purchase', 'purchase_temp', '0.0'), ('purchase', 'purchase_target', '0.0'), ('purchase', 'purchase_action', 'idle'), ('error', 'error', '1.0'), ('signup', 'signup_mode', 'off')) t(name, column_name, fallback)),
a AS (SELECT p.site_id, p.ts, n.name, n.column_name, n.fallback FROM polls p CROSS JOIN names n WHERE NOT EXISTS (SELECT 1 FROM states_v s WHERE s.site_id = p.site_id AND s.ts = p.ts AND s.name = n.name))
SELECT site_id, column_name AS name, fallback AS value, count(*) AS n FROM a GROUP BY 1, 2, 3""")
def states_complete(spark, sf):
    """Defaults of the entities that a poll did not report."""
    states = _entity_states(spark, sf).withColumn("ts", F.col("last_updated"))
    absent = st.with_absent(states, _dims(spark, sf)).filter(F.col("state").isNull())
    out = st.states_to_readings(absent, _dims(spark, sf), F.col("ts"), zero_fill=True)
    return out.groupBy("site_id", "name", "value").agg(F.count(F.lit(1)).alias("n"))


@query("history_series", f"""WITH {v.STATES} SELECT site_id, epoch_us(ts) AS ts_us, CASE WHEN k % 5 <> 0 THEN value END AS number, k % 2 = 0 AS flag,
CASE WHEN k % 2 = 0 THEN 'off' ELSE 'low' END AS fan, 'idle' AS action, CAST(k AS DOUBLE) AS target FROM states_v WHERE k % 13 <> 0 AND k % 11 <> 0""")
def history_series(spark, sf):
    s = v.states(spark, sf)
    k = F.col("k")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

    def landed(state):
        return s.select(
            "site_id", F.col("event_id").cast("string").alias("entity_id"),
            F.when(k % 13 == 0, "unavailable").otherwise(state).alias("state"),
            F.create_map(F.lit("temperature"), k.cast("string")).alias("attributes"),
            F.when(k % 3 == 0, F.lit("")).when(k % 11 == 0, F.lit("never")).otherwise(stamp).alias("last_changed"),
            F.when((k % 11 == 0), F.lit("never")).otherwise(stamp).alias("last_updated"),
        )

    key = ["site_id", "entity_id", "ts"]
    switch = F.when(k % 2 == 0, "off").otherwise("on")
    number = st.history_to_series(landed(F.when(k % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))), "numeric").withColumnRenamed("value", "number")
    flag = st.history_to_series(landed(switch), "binary", "off").withColumnRenamed("value", "flag")
    fan = st.history_to_series(landed(switch), "fan").withColumnRenamed("mode", "fan")
    climate = st.history_to_series(landed(F.lit("heat")), "climate").select(*key, "action", "target")
    return number.join(flag, key).join(fan, key).join(climate, key).select("site_id", v.us("ts").alias("ts_us"), "number", "flag", "fan", "action", "target")


@query("forecast_rows", f"""WITH {v.STATES} SELECT site_id, epoch_us(ts) AS target_us, value AS temperature, CASE WHEN k % 2 = 0 THEN 'sunny' ELSE 'unknown' END AS condition, CAST(k AS DOUBLE) AS wind_speed FROM states_v WHERE k % 9 <> 0""")
def forecast_json(spark, sf):
    s = v.states(spark, sf)
    k = F.col("k")
    point = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("datetime"),
        F.when(k % 9 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("temperature"),
        F.when(k % 2 == 0, "sunny").alias("condition"), k.cast("string").alias("wind_speed"),
    )
    replies = s.select("site_id", F.col("ts").alias("issued_at"), F.array(point).alias("forecast"))
    body = F.to_json(F.struct(F.create_map(F.lit("weather.home"), F.struct("forecast")).alias("service_response")))
    out = forecast_rows(replies.select("site_id", "issued_at", body.alias("body")), "weather.home")
    return out.select("site_id", v.us("target_ts").alias("target_us"), "temperature", "condition", "wind_speed")


@query("decisions_scan", R + "SELECT site_id, event_id, value AS predicted, event_id % 7 = 0 AS blocked, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 2 END AS lo FROM readings_v")
def decisions_scan(spark, sf):
    r = v.readings(spark, sf)
    landed = r.select(
        "site_id", "ts", F.col("event_id").cast("double").alias("comfort_cost"),
        F.to_json(F.create_map(F.lit("view"), F.create_map(F.lit("1h"), F.col("value")))).alias("predictions"),
        F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.to_json(F.create_map(F.lit("view"), F.create_map(F.lit("min"), F.col("value") / 2)))).alias("comfort_bounds"),
        F.when(F.col("event_id") % 7 == 0, F.lit('{"e0": "off"}')).alias("blocked"),
    )
    d = parse_decisions(landed)
    return d.select(
        "site_id", F.col("comfort_cost").cast("bigint").alias("event_id"), F.col("predictions")["view"]["1h"].alias("predicted"),
        F.coalesce(F.map_contains_key("blocked", F.lit("e0")), F.lit(False)).alias("blocked"), F.col("comfort_bounds")["view"]["min"].alias("lo"),
    )


# ── reshaping ──────────────────────────────────────────────────────────────
@query("pivot_wide", R + "SELECT site_id, epoch_us(date_trunc('hour', ts)) AS ts_us, " + ", ".join(f"min(value) FILTER (WHERE name = '{n}') AS {n}" for n in v.NAMES) + " FROM readings_v GROUP BY site_id, date_trunc('hour', ts)")
def pivot_wide(spark, sf):
    wide = rs.to_wide(v.readings(spark, sf).withColumn("ts", F.date_trunc("hour", "ts")), v.NAMES)
    return wide.select("site_id", v.us("ts").alias("ts_us"), *v.NAMES)


@query("unpivot_long", R + "SELECT site_id, epoch_us(date_trunc('hour', ts)) AS ts_us, name, min(value) AS value FROM readings_v GROUP BY site_id, date_trunc('hour', ts), name")
def unpivot_long(spark, sf):
    wide = rs.to_wide(v.readings(spark, sf).withColumn("ts", F.date_trunc("hour", "ts")), v.NAMES)
    return rs.to_long(wide).select("site_id", v.us("ts").alias("ts_us"), "name", F.col("value").cast("double").alias("value"))


def _hour_cells(spark, sf):
    r = v.readings(spark, sf)
    return r.groupBy("site_id", F.to_date("ts").alias("day"), "name", F.hour("ts").alias("hour")).agg(F.max("value").alias("value"))


CELLS = R + ", c AS (SELECT site_id, strftime(ts, '%Y-%m-%d') AS day, name, CAST(date_part('hour', ts) AS INTEGER) AS hour, max(value) AS value FROM readings_v GROUP BY 1, 2, 3, 4) "


@query("flatten_nested", CELLS + "SELECT * FROM c")
def flatten_nested(spark, sf):
    inner = _hour_cells(spark, sf).groupBy("site_id", "day", "name").agg(F.map_from_entries(F.collect_list(F.struct("hour", "value"))).alias("m"))
    nested = inner.groupBy("site_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("name", "m"))).alias("m"))
    return rs.flatten_map2(nested, "m", "name", "hour", "value").withColumn("day", F.col("day").cast("string"))


@query("transpose_nested", CELLS + "SELECT site_id, day, hour, name, value FROM c")
def transpose_nested(spark, sf):
    out = rs.transpose_map(_hour_cells(spark, sf), ["site_id", "day"], "name", "hour", "value", "by_name")
    return out.select("site_id", F.col("day").cast("string").alias("day"), "hour", F.explode("by_name").alias("name", "value"))


@query("nest_outcomes", CELLS + "SELECT site_id, day, name AS sensor, lpad(CAST(hour AS VARCHAR), 2, '0') AS horizon, value AS predicted, value / 2 AS actual, hour * 0.5 AS error FROM c")
def nest_outcomes(spark, sf):
    rows = _hour_cells(spark, sf).select(
        "site_id", F.col("day").alias("decision_ts"), F.col("name").alias("sensor"), F.lpad(F.col("hour").cast("string"), 2, "0").alias("horizon"),
        F.col("value").alias("predicted"), (F.col("value") / 2).alias("actual"), (F.col("hour") * F.lit(0.5)).alias("error"),
    )
    by_sensor = rs.nest_outcomes(rows).select("site_id", F.col("decision_ts").cast("string").alias("day"), F.explode("outcomes").alias("sensor", "horizons"))
    return by_sensor.select("site_id", "day", "sensor", F.explode("horizons").alias("horizon", "o")).select("site_id", "day", "sensor", "horizon", "o.*")


# ── lookups ────────────────────────────────────────────────────────────────
@query("schedule_join", f"WITH {v.READINGS}, {v.schedules_sql()} SELECT r.event_id, h.pref_lo, h.acc_hi, h.cold_penalty FROM readings_v r LEFT JOIN hours_v h ON h.site_id = r.site_id AND h.sensor = r.name AND h.hour = date_part('hour', r.ts)")
def schedule_join(spark, sf):
    r = v.readings(spark, sf).withColumnRenamed("name", "sensor")
    return lk.resolve_schedule(r, v.schedules(spark, sf), F.hour("ts")).select("event_id", "pref_lo", "acc_hi", "cold_penalty")


CODES = [("eff", "0", 1.0), ("eff", "1", 0.5), ("eff", "2", 0.25), ("cmd", "purchase", 0.75), ("gate", "click", 1.0), ("gate", "view", 1.0), ("gate", "purchase", 1.0)]


@query("encode_gate", f"WITH {v.STATES}, enc AS (SELECT * FROM (VALUES {v.values_sql(CODES)}) e(owner, label, code)) SELECT s.event_id, coalesce(a.code, b.code, 0.0) AS activity, coalesce(a.code, b.code, 0.0) * coalesce(g.code, 0.0) AS gated FROM states_v s LEFT JOIN enc a ON a.owner = 'eff' AND a.label = CAST(s.k % 6 AS VARCHAR) LEFT JOIN enc b ON b.owner = 'cmd' AND b.label = s.name LEFT JOIN enc g ON g.owner = 'gate' AND g.label = s.name")
def encode_gate(spark, sf):
    s = v.states(spark, sf)
    enc = spark.createDataFrame(CODES, "owner string, label string, code double")
    out = lk.encode_states(s, enc, F.lit("eff"), (F.col("k") % 6).cast("string"), F.col("name"), "activity", F.lit("cmd"))
    out = lk.encode_states(out, enc, F.lit("gate"), F.col("name"), into="gate")
    return out.select("event_id", "activity", lk.gated(F.col("activity"), F.col("gate")).alias("gated"))


HALVES = R + ", a AS (SELECT site_id, name, max(value) AS value FROM readings_v WHERE event_id % 2 = 0 AND value < 300 AND NOT (name = 'view' AND site_id < 4) GROUP BY 1, 2), b AS (SELECT site_id, name, max(value) AS value FROM readings_v WHERE event_id % 2 = 1 AND NOT (name = 'click' AND site_id > 12) GROUP BY 1, 2) "


def _halves(spark, sf):
    r = v.readings(spark, sf)
    a = r.filter((F.col("event_id") % 2 == 0) & (F.col("value") < 300) & ~((F.col("name") == "view") & (F.col("site_id") < 4)))
    b = r.filter((F.col("event_id") % 2 == 1) & ~((F.col("name") == "click") & (F.col("site_id") > 12)))
    return [x.groupBy("site_id", "name").agg(F.max("value").alias("value")) for x in (a, b)]


@query("compare_outer", HALVES + "SELECT coalesce(a.site_id, b.site_id) AS site_id, coalesce(a.name, b.name) AS name, coalesce(a.value, 0.0) AS old_value, coalesce(b.value, 0.0) AS new_value, CASE WHEN a.value IS NULL THEN 'new' WHEN b.value IS NULL THEN 'removed' ELSE 'both' END AS status FROM a FULL OUTER JOIN b ON a.site_id = b.site_id AND a.name = b.name")
def compare_outer(spark, sf):
    a, b = _halves(spark, sf)
    return lk.compare_versions(a, b, ["site_id", "name"], "value")


@query("compare_common", HALVES + "SELECT a.site_id, a.name, a.value AS old_value, b.value AS new_value FROM a JOIN b ON a.site_id = b.site_id AND a.name = b.name")
def compare_common(spark, sf):
    a, b = _halves(spark, sf)
    return lk.compare_common(a, b, ["site_id", "name"], ["value"])


@query("prefer_source", R + ", a AS (SELECT site_id, date_trunc('hour', ts) AS ts, max(value) AS value FROM readings_v WHERE name = 'view' GROUP BY 1, 2), b AS (SELECT site_id, date_trunc('hour', ts) AS ts, max(value) AS value FROM readings_v WHERE name <> 'view' GROUP BY 1, 2) SELECT site_id, epoch_us(ts) AS ts_us, value FROM a UNION ALL SELECT site_id, epoch_us(ts), value FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.site_id = b.site_id AND a.ts = b.ts)")
def prefer_source(spark, sf):
    r = v.readings(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    first, second = [r.filter(own).groupBy("site_id", "ts").agg(F.max("value").alias("value")) for own in (F.col("name") == "view", F.col("name") != "view")]
    return lk.prefer(first, second, ["site_id", "ts"]).select("site_id", v.us("ts").alias("ts_us"), "value")


@query("devices_with_effect", f"WITH {v.GAINS} SELECT DISTINCT site_id, effector AS device FROM gains_v g WHERE EXISTS (SELECT 1 FROM gains_v x WHERE x.site_id = g.site_id AND x.effector = g.effector AND (x.gain_f_per_hour > 1.9 OR x.t_statistic > 4.7))")
def devices_with_effect(spark, sf):
    g = v.gains(spark, sf).withColumnRenamed("effector", "device")
    devices = g.select("site_id", "device").distinct()
    return lk.with_effect(devices, [g.filter(F.col("gain_f_per_hour") > 1.9), g.filter(F.col("t_statistic") > 4.7)])


@query("key_sets", HALVES + ", u AS (SELECT site_id, name FROM a UNION SELECT site_id, name FROM b) SELECT site_id, name, EXISTS (SELECT 1 FROM a WHERE a.site_id = u.site_id AND a.name = u.name) AND EXISTS (SELECT 1 FROM b WHERE b.site_id = u.site_id AND b.name = u.name) AS in_both, NOT EXISTS (SELECT 1 FROM b WHERE b.site_id = u.site_id AND b.name = u.name) AS only_first FROM u")
def key_sets(spark, sf):
    a, b = _halves(spark, sf)
    keys = ["site_id", "name"]
    every = a.select(*keys).union(b.select(*keys)).distinct()
    both = lk.keep_keys(a, b, keys).select(*keys, F.lit(True).alias("in_both"))
    only = lk.drop_keys(a, b, keys).select(*keys, F.lit(True).alias("only_first"))
    return every.join(both, keys, "left").join(only, keys, "left").select(*keys, F.coalesce("in_both", F.lit(False)).alias("in_both"), F.coalesce("only_first", F.lit(False)).alias("only_first"))


@query("newest_rows", R + "SELECT event_id, site_id FROM readings_v ORDER BY ts DESC, event_id LIMIT 100")
def newest_rows(spark, sf):
    return v.readings(spark, sf).orderBy(F.col("ts").desc(), "event_id").limit(100).select("event_id", "site_id")


# ── aggregates ─────────────────────────────────────────────────────────────
@query("best_gain", f"WITH {v.GAINS}, {v.EFFECTORS_SQL} SELECT site_id, sensor, effector, gain_f_per_hour FROM gains_v g WHERE gain_f_per_hour > 0 AND EXISTS (SELECT 1 FROM effectors_v e WHERE e.site_id = g.site_id AND e.name = g.effector AND e.control_type = 'trajectory') QUALIFY row_number() OVER (PARTITION BY site_id, sensor ORDER BY gain_f_per_hour DESC, effector) = 1")
def best_gain(spark, sf):
    return agg.best_gain(v.gains(spark, sf), v.effectors(spark, sf))


@query("weighted_median", "WITH m AS (SELECT l_suppkey % 16 AS site_id, l_discount AS x, CAST(sum(l_quantity) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY site_id ORDER BY x) AS cum, sum(w) OVER (PARTITION BY site_id) AS total FROM m) SELECT site_id, round(min(x), 2) AS weighted_median FROM c WHERE cum >= total / 2.0 GROUP BY 1")
def weighted_median(spark, sf):
    l = v.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 16).alias("site_id"), F.col("l_discount").alias("x"), F.col("l_quantity").cast("bigint").alias("w"))
    return agg.weighted_median(l, ["site_id"], "x", "w", 2)


@query("accuracy", f"WITH {v.STATES} SELECT site_id, ['1h', '2h', '4h', '6h'][k % 4 + 1] AS horizon, round(avg(abs(value - k)), 3) AS mae, round(avg(value - k), 3) AS bias, count(*) AS n FROM states_v WHERE ts > TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1, 2")
def accuracy(spark, sf):
    s = v.states(spark, sf)
    label = F.element_at(F.array(*[F.lit(h) for h in ("1h", "2h", "4h", "6h")]), F.col("k") % 4 + 1)
    rows = s.select("site_id", F.col("ts").alias("decision_ts"), label.alias("horizon"), (F.col("value") - F.col("k")).alias("error"))
    return agg.accuracy_by_horizon(rows, newer_than=F.lit("2024-01-10").cast("timestamp"))


@query("rmse_sets", f"WITH {v.STATES}, e AS (SELECT name AS model, 'r' || (site_id % 8) AS room, (k % 5) AS h, value - k AS error FROM states_v) SELECT model, room, h, round(sqrt(avg(error * error)), 6) AS rmse, round(avg(error), 6) AS bias, count(*) AS n FROM e GROUP BY GROUPING SETS ((model, h), (model, room, h))")
def rmse_sets(spark, sf):
    s = v.states(spark, sf)
    rows = s.select(F.col("name").alias("model"), F.concat(F.lit("r"), (F.col("site_id") % 8).cast("string")).alias("room"), (F.col("k") % 5).alias("h"), (F.col("value") - F.col("k")).alias("error"))
    out = agg.error_sets(rows, [["model", "h"], ["model", "room", "h"]])
    return out.select("model", "room", "h", v.r6("rmse").alias("rmse"), v.r6("bias").alias("bias"), "n")


@query("comfort_stats", f"WITH {v.STATES} SELECT site_id, name, round(avg(CASE WHEN k % 9 <> 0 THEN CASE WHEN value >= 20 AND value <= 80 THEN 100.0 ELSE 0.0 END END), 6) AS pct_in_band, round(avg(CASE WHEN k % 9 <> 0 THEN CASE WHEN value < 20 THEN 100.0 ELSE 0.0 END END), 6) AS pct_below, round(avg(CASE WHEN k % 9 <> 0 THEN CASE WHEN value > 80 THEN 100.0 ELSE 0.0 END END), 6) AS pct_above, round(coalesce(avg(CASE WHEN k % 9 <> 0 THEN CASE WHEN value < 20 THEN 20 - value WHEN value > 80 THEN value - 80 END END), 0), 6) AS avg_violation FROM states_v GROUP BY 1, 2")
def comfort_stats(spark, sf):
    s = v.states(spark, sf).withColumns({"temp": F.when(F.col("k") % 9 != 0, F.col("value")), "lo": F.lit(20.0), "hi": F.lit(80.0)})
    out = agg.comfort_stats(s, ["site_id", "name"])
    return out.select("site_id", "name", *[v.r6(c).alias(c) for c in ("pct_in_band", "pct_below", "pct_above", "avg_violation")])


@query("capacity_stats", f"WITH {v.STATES}, c AS (SELECT site_id, name, CASE WHEN value < 20 THEN 20 - value WHEN value > 80 THEN 80 - value ELSE 0 END AS x, k >= 50 AS f FROM states_v) SELECT site_id, name, count(*) FILTER (WHERE x > 0) AS cold_total, count(*) FILTER (WHERE x > 0 AND f) AS cold_capacity, count(*) FILTER (WHERE x > 0 AND NOT f) AS cold_control, count(*) FILTER (WHERE x < 0) AS hot_total, count(*) FILTER (WHERE x < 0 AND f) AS hot_capacity, count(*) FILTER (WHERE x < 0 AND NOT f) AS hot_control FROM c GROUP BY 1, 2")
def capacity_stats(spark, sf):
    x = F.when(F.col("value") < 20, 20 - F.col("value")).when(F.col("value") > 80, 80 - F.col("value")).otherwise(0.0)
    return agg.capacity_stats(v.states(spark, sf).withColumns({"violation": x, "at_capacity": F.col("k") >= 50}), ["site_id", "name"])


@query("usable_sources", f"WITH {v.HOURLY} SELECT site_id, count(view) > 100 AS view_usable, count(click) > 100 AS click_usable FROM hourly_v GROUP BY 1")
def usable_sources(spark, sf):
    return agg.usable_sources(v.hourly(spark, sf), ["view", "click"])


@query("filled_fraction", f"WITH {v.HOURLY}, f AS (SELECT site_id, 'view' AS column_name, avg(CASE WHEN view IS NULL THEN 0.0 ELSE 1.0 END) AS fraction FROM hourly_v GROUP BY 1 UNION ALL SELECT site_id, 'click', avg(CASE WHEN click IS NULL THEN 0.0 ELSE 1.0 END) FROM hourly_v GROUP BY 1) SELECT site_id, column_name, round(fraction, 6) AS fraction, fraction >= 0.15 AS kept FROM f")
def filled_fraction(spark, sf):
    out = agg.filled_fraction(v.hourly(spark, sf), ["view", "click"], minimum=0.15)
    return out.select("site_id", "column_name", v.r6("fraction").alias("fraction"), "kept")


@query("supported_features", f"WITH {v.STATES} SELECT site_id, name, sum(k % 2) AS n_active, sum(k % 2) >= 50 AS supported, count(*) >= greatest(20 + 10, 100) AS enough FROM states_v GROUP BY 1, 2")
def supported_features(spark, sf):
    s = v.states(spark, sf).withColumn("state", (F.col("k") % 2).cast("double"))
    counts = s.groupBy("site_id", "name").agg(F.count(F.lit(1)).alias("n"))
    out = agg.supported_features(s, ["site_id", "name"]).join(counts, ["site_id", "name"])
    return out.select("site_id", "name", F.col("active_rows").cast("bigint").alias("n_active"), "supported", agg.enough_rows(F.col("n"), 20, 100).alias("enough"))


@query("run_latest", f"WITH {v.RUNS}, m AS (SELECT mode, experiment, max(timestamp) AS timestamp FROM runs_v GROUP BY 1, 2) SELECT r.mode, r.experiment, r.timestamp, count(*) AS n_targets, round(avg(rmse), 6) AS mean_rmse, round(avg(mae), 6) AS mean_mae FROM runs_v r JOIN m USING (mode, experiment, timestamp) GROUP BY 1, 2, 3")
def run_latest(spark, sf):
    r = v.runs(spark, sf)
    means = agg.run_means(r, ["mode", "experiment", "timestamp"])
    out = agg.latest_runs(means)
    return out.select("mode", "experiment", "timestamp", "n_targets", v.r6("mean_rmse").alias("mean_rmse"), v.r6("mean_mae").alias("mean_mae"))


@query("run_history", f"WITH {v.RUNS} SELECT mode || '/' || experiment AS label, timestamp, round(avg(rmse), 6) AS mean_rmse, round(avg(mae), 6) AS mean_mae FROM runs_v GROUP BY mode, experiment, timestamp")
def run_history_query(spark, sf):
    r = v.runs(spark, sf)
    docs = r.groupBy("mode", "experiment", "timestamp").agg(F.collect_list(F.struct("target", "rmse", "mae", F.lit(0).alias("n_train"), "n_val")).alias("targets"))
    docs = docs.withColumns({"file": F.lit("x.json"), "git_hash": F.lit(None).cast("string"), "data": F.struct(F.lit(0).alias("rows_raw"), F.lit(0).alias("n_features"))})
    return run_history(docs).select("label", "timestamp", v.r6("mean_rmse").alias("mean_rmse"), v.r6("mean_mae").alias("mean_mae"))


@query("run_targets", f"WITH {v.RUNS} SELECT mode, experiment, timestamp, regexp_extract(target, '^(.+)_temp_t', 1) AS room, CASE split_part(target, '+', 2) WHEN '12' THEN '12h' WHEN '24' THEN '2h' ELSE 't+36' END AS horizon, rmse FROM runs_v")
def run_targets_query(spark, sf):
    r = v.runs(spark, sf)
    docs = r.groupBy("mode", "experiment", "timestamp").agg(F.collect_list(F.struct("target", "rmse", "mae", F.lit(0).alias("n_train"), "n_val")).alias("targets"))
    return run_targets(docs).select("mode", "experiment", "timestamp", "room", "horizon", "rmse")


@query("win_loss_tie", f"WITH {v.RUNS}, a AS (SELECT * FROM runs_v WHERE experiment = 'F'), b AS (SELECT * FROM runs_v WHERE experiment = 'O'), p AS (SELECT a.mode, b.rmse - a.rmse AS d FROM a JOIN b ON a.mode = b.mode AND a.timestamp = b.timestamp AND a.target = b.target) SELECT mode, count(*) FILTER (WHERE d < -0.005) AS wins, count(*) FILTER (WHERE d > 0.005) AS losses, count(*) FILTER (WHERE d >= -0.005 AND d <= 0.005) AS ties, round(avg(d), 6) AS mean_delta, count(*) AS compared FROM p GROUP BY 1")
def win_loss_tie(spark, sf):
    r = v.runs(spark, sf)
    pairs = lk.compare_common(r.filter(F.col("experiment") == "F"), r.filter(F.col("experiment") == "O"), ["mode", "timestamp", "target"], ["rmse"])
    out = agg.win_loss_tie(pairs, ["mode"])
    return out.select("mode", "wins", "losses", "ties", v.r6("mean_delta").alias("mean_delta"), "compared")


@query("direct_cross", f"WITH {v.GAINS}, r AS (SELECT *, row_number() OVER (PARTITION BY site_id, effector ORDER BY NOT negligible DESC, abs(gain_f_per_hour) DESC, sensor) AS rn FROM gains_v), d AS (SELECT site_id, effector, coalesce(max(sensor) FILTER (WHERE rn = 1 AND NOT negligible), '(none)') AS direct_sensor, coalesce(max(gain_f_per_hour) FILTER (WHERE rn = 1 AND NOT negligible), 0.0) AS direct_gain, count(*) FILTER (WHERE rn > 1 AND NOT negligible) AS n_cross, coalesce(avg(abs(gain_f_per_hour)) FILTER (WHERE rn > 1 AND NOT negligible), 0.0) AS mean_cross FROM r GROUP BY 1, 2) SELECT site_id, effector, direct_sensor, direct_gain, n_cross, round(mean_cross, 6) AS mean_cross_gain, round(CASE WHEN abs(direct_gain) > 0 THEN mean_cross / abs(direct_gain) ELSE 0 END, 6) AS cross_direct_ratio FROM d")
def direct_cross(spark, sf):
    out = agg.direct_and_cross(v.gains(spark, sf))
    return out.select("site_id", "effector", "direct_sensor", "direct_gain", "n_cross", v.r6("mean_cross_gain").alias("mean_cross_gain"), v.r6("cross_direct_ratio").alias("cross_direct_ratio"))


@query("feature_importance", "SELECT p_type AS feature, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS mean_gain, count(*) AS n_models FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def feature_importance(spark, sf):
    l = v.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("gain"))
    rows = l.join(v.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("feature")), ["p_partkey"])
    return agg.feature_importance(rows).select("feature", v.r6("mean_gain").alias("mean_gain"), "n_models")


STABLE = f"""WITH {v.STATES}, l AS (SELECT *, lag(ts) OVER (PARTITION BY site_id ORDER BY ts, event_id) AS prev FROM states_v),
s AS (SELECT *, CAST(sum(CASE WHEN epoch_us(ts) - epoch_us(prev) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY ts, event_id) AS BIGINT) AS segment_id FROM l)
SELECT site_id, segment_id FROM s GROUP BY 1, 2 HAVING count(DISTINCT CASE WHEN k % 10 <> 0 THEN k // 50 END) <= 1 AND count(*) >= 2"""


@query("stable_segments", STABLE)
def stable_segments(spark, sf):
    tagged = sp.gap_segments(v.states(spark, sf), Track(("site_id",), "ts", ("event_id",)), 1800, 2)
    half = F.when(F.col("k") % 10 != 0, F.floor(F.col("k") / 50))
    return agg.stable_segments(tagged.withColumn("window", half), ["site_id", "segment_id"], ["window"])


@query("usable_gains", f"WITH {v.GAINS}, {v.EFFECTORS_SQL} SELECT g.site_id, g.effector, g.sensor, greatest(-1.5, least(1.5, g.gain_f_per_hour)) AS gain FROM gains_v g LEFT JOIN effectors_v e ON e.site_id = g.site_id AND e.name = g.effector WHERE NOT g.negligible AND abs(g.t_statistic) >= 1.5 AND NOT (e.name IN ('e4', 'e6') AND g.gain_f_per_hour < 0) AND NOT (e.name = 'e5' AND g.gain_f_per_hour > 0)")
def usable_gains_query(spark, sf):
    modes = F.when(F.col("name").isin("e4", "e6"), F.array(F.lit("heat"))).when(F.col("name") == "e5", F.array(F.lit("cool"))).otherwise(F.array(F.lit("heat"), F.lit("cool")))
    out = usable_gains(v.gains(spark, sf), v.effectors(spark, sf).withColumn("supported_modes", modes), cap=1.5)
    return out.select("site_id", "effector", "sensor", F.col("gain_f_per_hour").alias("gain"))


@query("hour_windows", R + "SELECT name, count(*) FILTER (WHERE date_part('hour', ts) >= 22 OR date_part('hour', ts) < 7) AS quiet, count(*) FILTER (WHERE date_part('hour', ts) >= 9 AND date_part('hour', ts) < 17) AS office FROM readings_v GROUP BY 1")
def hour_windows(spark, sf):
    h = F.hour("ts")
    return v.readings(spark, sf).groupBy("name").agg(F.count_if(hour_in_window(h, 22, 7)).alias("quiet"), F.count_if(hour_in_window(h, 9, 17)).alias("office"))
