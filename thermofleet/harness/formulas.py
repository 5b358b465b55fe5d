"""Scalar formulas applied to whole tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from thermofleet.functions import bands as bd
from thermofleet.functions import labels as lb
from thermofleet.functions import thermal as th
from thermofleet.functions import timekeys as tk
from thermofleet.functions import units as un
from thermofleet.functions import weather as we
from thermofleet.harness import views as v
from thermofleet.harness.registry import query

S = f"WITH {v.STATES} "
CONDITIONS = list(we.SOLAR_FRACTION) + ["dusty"]


@query("solar_features", S + f""", c AS (SELECT event_id, ts, k, [{", ".join(f"'{c}'" for c in CONDITIONS)}][k % {len(CONDITIONS)} + 1] AS condition FROM states_v),
e AS (SELECT *, radians(23.45 * sin(radians(360.0 / 365.0 * (dayofyear(ts) - 81)))) AS d,
radians(15.0 * (date_part('hour', ts) + date_part('minute', ts) / 60.0 + floor(date_part('second', ts)) / 3600.0 + (-122.3) / 15.0 - 12.0)) AS h FROM c),
s AS (SELECT *, degrees(asin(greatest(-1.0, least(1.0, sin(radians(47.6)) * sin(d) + cos(radians(47.6)) * cos(d) * cos(h))))) AS elev FROM e)
SELECT s.event_id, round(elev, 6) AS elevation, round(greatest(0.0, sin(radians(elev))), 6) AS sine, coalesce(f.fraction, 0.3) AS fraction, coalesce(f.code, 15) AS code
FROM s LEFT JOIN (VALUES {v.values_sql([(c, float(x), we.CONDITIONS.index(c) if c in we.CONDITIONS else 15) for c, x in we.SOLAR_FRACTION.items()])}) f(name, fraction, code) ON f.name = s.condition""")
def solar_features(spark, sf):
    s = v.states(spark, sf)
    condition = F.element_at(F.array(*[F.lit(c) for c in CONDITIONS]), F.col("k") % len(CONDITIONS) + 1)
    elevation = we.solar_elevation(F.lit(47.6), F.lit(-122.3), F.col("ts"))
    return s.select("event_id", v.r6(elevation).alias("elevation"), v.r6(we.positive_sine(elevation)).alias("sine"),
                    we.solar_fraction(condition).alias("fraction"), we.condition_code(condition).alias("code"))


@query("day_harmonics", S + f""", a AS (SELECT event_id, (date_part('hour', l) + date_part('minute', l) / 60.0) * {2 * math.pi / 24!r} AS a FROM (SELECT event_id, ts - INTERVAL 7 HOUR AS l FROM states_v))
SELECT event_id, round(sin(a), 6) AS tod_sin1, round(cos(a), 6) AS tod_cos1, round(sin(2 * a), 6) AS tod_sin2, round(cos(2 * a), 6) AS tod_cos2 FROM a""")
def day_harmonics(spark, sf):
    out = tk.day_harmonics(F.col("ts"), "America/Phoenix")
    return v.states(spark, sf).select("event_id", *[v.r6(c).alias(n) for n, c in out.items()])


@query("weather_controls", S + "SELECT event_id, round((k - value) * (k - value) * sign(k - value), 6) AS weather_dt2, round(coalesce(CASE WHEN k % 3 <> 0 THEN k END, 0) * (k - value), 6) AS weather_wind_dt, round(1.5 - (k - value) / 45.0, 6) AS residual FROM states_v")
def weather_controls(spark, sf):
    k = F.col("k").cast("double")
    out = th.weather_controls(k, F.col("value"), F.when(F.col("k") % 3 != 0, k), F.lit(0.0))
    return v.states(spark, sf).select(
        "event_id", v.r6(out["weather_dt2"]).alias("weather_dt2"), v.r6(out["weather_wind_dt"]).alias("weather_wind_dt"),
        v.r6(th.newton_residual(F.lit(1.5), k, F.col("value"), F.lit(45.0))).alias("residual"),
    )


@query("effective_tau", S + """, b AS (SELECT site_id, name, max(value) / 10.0 + 1 AS tau, count(*) FILTER (WHERE k >= 50) AS n FROM states_v GROUP BY 1, 2),
a AS (SELECT s.site_id, s.name, sum(s.k / 100000.0) AS beta FROM states_v s WHERE s.k % 2 = 0 GROUP BY 1, 2), t AS (SELECT b.*, 1.0 / greatest(1.0 / tau + coalesce(beta, 0.0), 0.01) AS eff FROM b LEFT JOIN a USING (site_id, name))
SELECT site_id, name, round(tau, 6) AS tau_base, round(eff, 6) AS tau_eff, CASE WHEN eff / tau < 0.3 THEN 'extreme' WHEN eff / tau < 0.5 THEN 'fast' ELSE '' END AS flag FROM t""")
def effective_tau(spark, sf):
    s = v.states(spark, sf)
    base = s.groupBy("site_id", "name").agg((F.max("value") / 10.0 + 1).alias("tau_base"))
    betas = s.filter(F.col("k") % 2 == 0).groupBy("site_id", "name").agg(F.sum(F.col("k") / 100000.0).alias("beta"))
    out = base.join(betas, ["site_id", "name"], "left").withColumn("tau_eff", th.effective_tau(F.col("tau_base"), F.col("beta")))
    return out.select("site_id", "name", v.r6("tau_base").alias("tau_base"), v.r6("tau_eff").alias("tau_eff"), th.tau_flag(F.col("tau_eff"), F.col("tau_base")).alias("flag"))


@query("newton_fold", f"""WITH {v.STATES}, o AS (SELECT site_id, date_trunc('day', ts) AS day, date_part('hour', ts) AS h, max(value) AS t FROM states_v WHERE name = 'view' GROUP BY 1, 2, 3),
arr AS (SELECT site_id, day, list(t ORDER BY h) AS outdoor FROM o GROUP BY 1, 2),
q AS (SELECT s.event_id, s.value AS cur, s.k % 7 + CASE WHEN s.k % 2 = 0 THEN 0.5 ELSE 0.0 END AS hours, 5.0 + s.k AS tau, coalesce(a.outdoor, []) AS outdoor FROM states_v s LEFT JOIN arr a ON a.site_id = s.site_id AND a.day = date_trunc('day', s.ts)),
w AS (SELECT *, CAST(floor(hours) AS INTEGER) AS n, len(outdoor) AS m FROM q),
x AS (SELECT *, exp(-1.0 / tau) AS a FROM w),
f AS (SELECT *, CASE WHEN n = 0 THEN cur ELSE pow(a, n) * cur + (1 - a) * list_sum([pow(a, n - 1 - i) * outdoor[least(i, m - 1) + 1] FOR i IN range(n)]) END AS t FROM x)
SELECT event_id, round(CASE WHEN m = 0 OR hours <= 0 THEN cur WHEN hours > n THEN outdoor[least(n, m - 1) + 1] + (t - outdoor[least(n, m - 1) + 1]) * exp(-(hours - n) / tau) ELSE t END, 5) AS predicted FROM f""")
def newton_fold(spark, sf):
    s = v.states(spark, sf)
    day = F.date_trunc("day", "ts")
    views = s.filter(F.col("name") == "view").groupBy("site_id", day.alias("day"), F.hour("ts").alias("h")).agg(F.max("value").alias("t"))
    arrays = views.groupBy("site_id", "day").agg(F.transform(F.sort_array(F.collect_list(F.struct("h", "t"))), lambda p: p["t"]).alias("outdoor"))
    asked = s.withColumn("day", day).join(arrays, ["site_id", "day"], "left")
    hours = F.col("k") % 7 + F.when(F.col("k") % 2 == 0, 0.5).otherwise(0.0)
    out = asked.withColumns({"hours": hours, "tau": 5.0 + F.col("k"), "outdoor": F.coalesce("outdoor", F.array().cast("array<double>"))})
    return out.select("event_id", F.round(th.newton_fold(F.col("value"), F.col("outdoor"), F.col("tau"), F.col("hours")), 5).alias("predicted"))


@query("outdoor_at_lead", S + ", q AS (SELECT event_id, value, k, k % 6 + CASE WHEN k % 2 = 0 THEN 0.25 ELSE 0.0 END AS hours FROM states_v) SELECT event_id, round(CASE WHEN hours <= 0 THEN value WHEN hours < 1 THEN value + hours * (k - value) ELSE [k, k + 1, k + 2][least(CAST(floor(hours) AS INTEGER), 3)] END, 6) AS outdoor FROM q")
def outdoor_at_lead(spark, sf):
    k = F.col("k").cast("double")
    hours = F.col("k") % 6 + F.when(F.col("k") % 2 == 0, 0.25).otherwise(0.0)
    return v.states(spark, sf).select("event_id", v.r6(th.outdoor_at(F.col("value"), F.array(k, k + 1, k + 2), hours)).alias("outdoor"))


@query("band_status", S + "SELECT event_id, CASE WHEN k % 10 = 0 THEN '' WHEN value < 20 THEN 'COLD' WHEN value > 80 THEN 'HOT' WHEN value < 40 THEN 'below pref' WHEN value > 60 THEN 'above pref' ELSE 'in band' END AS status, array_to_string([x FOR x IN [CASE WHEN value > 80 AND k > 50 THEN 'heats_hot_sensor' END, CASE WHEN value < 20 AND k < 50 THEN 'cools_cold_sensor' END, CASE WHEN name = 'error' THEN 'outdoor_target' END, CASE WHEN abs((k - 50) / 25.0) > 1.0 THEN 'implausible_magnitude' END] IF x IS NOT NULL], ',') AS flags FROM states_v")
def band_status(spark, sf):
    temp = F.when(F.col("k") % 10 != 0, F.col("value"))
    gain = (F.col("k") - 50) / 25.0
    sensor = F.when(F.col("name") == "error", "outdoor_temp").otherwise(F.col("name"))
    flags = bd.contradiction_flags(gain, F.col("value"), F.lit(20.0), F.lit(80.0), sensor)
    return v.states(spark, sf).select("event_id", bd.band_status(temp, F.lit(20.0), F.lit(80.0), F.lit(40.0), F.lit(60.0)).alias("status"), F.array_join(flags, ",").alias("flags"))


@query("setpoints", S + "SELECT event_id, round(greatest(62.0, least(78.0, CASE WHEN k % 2 = 0 THEN greatest(value + 2, 65.0 + 2) ELSE 65.0 - 1 END)), 6) AS setpoint, round(1.0 - least(value / 10.0, 0.9), 6) AS confidence, coalesce(CASE WHEN k % 3 = 0 THEN NULL ELSE value END, CASE WHEN k % 2 = 0 THEN k END) AS outdoor FROM states_v")
def setpoints(spark, sf):
    k = F.col("k")
    return v.states(spark, sf).select(
        "event_id", v.r6(th.cautious_setpoint(F.col("value"), k % 2 == 0, F.lit(65.0))).alias("setpoint"),
        v.r6(th.command_confidence(F.col("value"))).alias("confidence"),
        th.outdoor_source(F.when(k % 3 != 0, F.col("value")), F.when(k % 2 == 0, k.cast("double"))).alias("outdoor"),
    )


@query("unit_conversion", "SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE (p_retailprice - 32.0) * 5.0 / 9.0 END, 6) AS absolute, round(CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE p_retailprice * (CAST(5.0 AS DOUBLE) / 9.0) END, 6) AS delta FROM part")
def unit_conversion(spark, sf):
    unit = F.when(F.col("p_size") % 2 == 0, "F").otherwise("C")
    return v.table(spark, sf, "part").select("p_partkey", v.r6(un.abs_temp(F.col("p_retailprice"), unit)).alias("absolute"), v.r6(un.delta_temp(F.col("p_retailprice"), unit)).alias("delta"))


@query("lag_midpoints", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE (p_size + p_size * 3) / 2.0 END AS minutes FROM part")
def lag_midpoints(spark, sf):
    size = F.col("p_size").cast("string")
    label = F.when(F.col("p_size") % 7 == 0, size).otherwise(F.concat(size, F.lit("_"), (F.col("p_size") * 3).cast("string")))
    return v.table(spark, sf, "part").select("p_partkey", lb.lag_midpoint(label).alias("minutes"))


@query("percent_change", S + ", q AS (SELECT event_id, floor(value / 20) AS o, CAST(k AS DOUBLE) AS n, name FROM states_v), p AS (SELECT *, CASE WHEN o = 0 THEN NULL ELSE (n - o) / abs(o) * 100.0 END AS pct FROM q) SELECT event_id, round(pct, 6) AS pct, CASE WHEN pct IS NULL THEN 'n/a' WHEN pct < -1 THEN 'down' WHEN pct > 1 THEN 'up' ELSE 'flat' END AS direction, CASE name WHEN 'view' THEN CASE WHEN n <= o THEN 'pass' ELSE 'fail' END WHEN 'click' THEN CASE WHEN n >= o * 0.9 THEN 'pass' ELSE 'fail' END ELSE CASE WHEN abs(n - o) / greatest(abs(o), 0.001) < 0.2 THEN 'pass' ELSE 'check' END END AS verdict FROM p")
def percent_change(spark, sf):
    s = v.states(spark, sf).withColumns({"o": F.floor(F.col("value") / 20).cast("double"), "n": F.col("k").cast("double")})
    want = F.when(F.col("name") == "view", "lower").when(F.col("name") == "click", "keep").otherwise("stable")
    pct = bd.percent_change(F.col("o"), F.col("n"))
    return s.select("event_id", v.r6(pct).alias("pct"), bd.change_direction(pct).alias("direction"), bd.metric_verdict(want, F.col("o"), F.col("n")).alias("verdict"))
