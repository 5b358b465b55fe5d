"""Feature preparation, time constants, ridge fits and their diagnostics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from thermofleet.fitting import gains as g
from thermofleet.fitting import ridge as rg
from thermofleet.fitting.gram import gram
from thermofleet.fitting.pipeline import fit_sites
from thermofleet.fitting.prepare import Effector, Layout, design, prepare, uncontrolled_segments, with_place, with_sun
from thermofleet.fitting.tau import POINTS, first_grid, fit_segments, sealed_and_ventilated, sensor_taus
from thermofleet.harness import views as v
from thermofleet.harness.registry import query
from thermofleet.operators import aggregates as agg
from thermofleet.operators import spans as sp
from thermofleet.operators.smoothing import bin_label, lag_bins
from thermofleet.operators.track import Track

SITE_ROWS = Track(("site_id",), "ts", ("event_id",))


def _wide(spark, sf):
    """The hourly grid with a text mode column next to the numbers."""
    wide = v.hourly(spark, sf)
    mode = F.when(F.col("error").isNull(), "off").when(F.col("error") > 100, "high").otherwise("low")
    return wide.withColumn("unit_mode", mode).withColumn("gate", F.when(F.col("signup").isNull(), "closed").otherwise("open"))


LAYOUT = Layout(
    sensors=["view"],
    effectors=[Effector("unit", "unit_mode", {"low": 0.5, "high": 1.0}, 90, gate="flow")],
    gates={"flow": ("gate", {"open": 1.0})}, outdoor_sensor="purchase", weather_outdoor="click", step_seconds=v.HOUR,
)


def _prepare_sql() -> str:
    bins = ", ".join(
        f"round(coalesce(sum(act) OVER (PARTITION BY site_id ORDER BY ts ROWS BETWEEN {e - 1} PRECEDING AND {s} PRECEDING), 0) / {float(e - s)}, 6) AS lag_{bin_label(s, e)}"
        for s, e in lag_bins(90)
    )
    return f"""WITH {v.HOURLY}, p AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS pos FROM hourly_v),
k AS (SELECT *, last_value(CASE WHEN click IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS p0, last_value(click IGNORE NULLS) OVER w AS v0, first_value(CASE WHEN click IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS p1, first_value(click IGNORE NULLS) OVER f AS v1,
count(click) OVER (PARTITION BY site_id) > 100 AS cu, count(purchase) OVER (PARTITION BY site_id) > 100 AS pu, CASE WHEN signup IS NULL OR error IS NULL THEN 0.0 WHEN error > 100 THEN 1.0 ELSE 0.5 END AS act,
CASE WHEN count(view) OVER r >= 4 THEN avg(view) OVER r END AS smooth FROM p
WINDOW w AS (PARTITION BY site_id ORDER BY ts ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY site_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), r AS (PARTITION BY site_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
o AS (SELECT *, coalesce(CASE WHEN pu THEN purchase END, CASE WHEN cu THEN CASE WHEN click IS NOT NULL THEN click WHEN pos - p0 <= 24 THEN CASE WHEN p1 IS NULL THEN v0 ELSE v0 + (v1 - v0) / (p1 - p0) * (pos - p0) END END END) AS ob FROM k)
SELECT site_id, epoch_us(ts) AS ts_us, round(ob, 6) AS outdoor_best, round(CASE WHEN lead(pos) OVER t IS NOT NULL AND lag(pos) OVER t IS NOT NULL THEN (lead(ob) OVER t - lag(ob) OVER t) / 2.0 WHEN lead(pos) OVER t IS NOT NULL THEN lead(ob) OVER t - ob ELSE ob - lag(ob) OVER t END, 8) AS outdoor_rate,
round((lead(smooth, 3) OVER t - lag(smooth, 3) OVER t) / 6.0, 6) AS rate_view, {bins} FROM o WINDOW t AS (PARTITION BY site_id ORDER BY ts)"""


@query("site_sun", f"""WITH {v.READINGS}, p AS (SELECT *, CASE site_id % 3 WHEN 0 THEN 35.7 WHEN 1 THEN 33.4 ELSE 47.6 END AS lat, CASE site_id % 3 WHEN 0 THEN 139.7 WHEN 1 THEN -112.0 ELSE -122.3 END AS lon, CASE site_id % 3 WHEN 0 THEN 9 WHEN 1 THEN -7 ELSE 0 END AS off FROM readings_v),
e AS (SELECT *, radians(23.45 * sin(radians(360.0 / 365.0 * (dayofyear(ts) - 81)))) AS d, radians(15.0 * (date_part('hour', ts) + date_part('minute', ts) / 60.0 + floor(date_part('second', ts)) / 3600.0 + lon / 15.0 - 12.0)) AS h FROM p)
SELECT event_id, CAST(date_part('hour', ts + to_hours(off)) AS INTEGER) AS local_hour, round(degrees(asin(greatest(-1.0, least(1.0, sin(radians(lat)) * sin(d) + cos(radians(lat)) * cos(d) * cos(h))))), 6) AS solar_elev_deg FROM e""")
def site_sun(spark, sf):
    """Two thirds of the sites have a place of their own, the others the layout's."""
    kind = F.col("site_id") % 3
    places = v.sites(spark, sf).filter(kind < 2).select(
        "site_id", F.when(kind == 0, 35.7).otherwise(33.4).alias("latitude"), F.when(kind == 0, 139.7).otherwise(-112.0).alias("longitude"),
        F.when(kind == 0, "Asia/Tokyo").otherwise("America/Phoenix").alias("zone"))
    out = with_sun(with_place(v.readings(spark, sf), LAYOUT, places))
    return out.select("event_id", "local_hour", v.r6("solar_elev_deg").alias("solar_elev_deg"))


@query("prepared_features", _prepare_sql())
def prepared_features(spark, sf):
    out = prepare(_wide(spark, sf), LAYOUT)
    lags = [(f"lag_unit_{bin_label(s, e)}", f"lag_{bin_label(s, e)}") for s, e in lag_bins(90)]
    return out.select("site_id", v.us("ts").alias("ts_us"), v.r6("outdoor_best").alias("outdoor_best"), F.round("outdoor_rate", 8).alias("outdoor_rate"),
                      v.r6("rate_view").alias("rate_view"), *[v.r6(a).alias(b) for a, b in lags])


PASSIVE = f"""WITH {v.STATES}, q AS (SELECT * FROM states_v WHERE k / 12.0 < 5 AND event_id % 5 <> 0), l AS (SELECT *, lag(ts) OVER (PARTITION BY site_id, name ORDER BY ts) AS prev FROM q),
s AS (SELECT *, CAST(sum(CASE WHEN epoch_us(ts) - epoch_us(prev) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY site_id, name ORDER BY ts) AS BIGINT) AS segment_id FROM l),
ok AS (SELECT site_id, name, segment_id, count(*) AS n FROM s GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND count(DISTINCT CASE WHEN k % 7 <> 0 THEN k // 30 END) <= 1)"""


@query("uncontrolled_segments", PASSIVE + " SELECT site_id, name AS sensor, segment_id, n FROM ok")
def uncontrolled(spark, sf):
    s = v.states(spark, sf)
    rows = s.select("site_id", F.col("name").alias("sensor"), "ts", F.col("value").alias("temp"), F.col("k").cast("double").alias("outdoor_best"), (F.col("k") / 12.0).alias("solar_elev_deg"),
                    F.when(F.col("event_id") % 5 == 0, 1.0).otherwise(0.0).alias("eff_unit"), F.when(F.col("k") % 7 != 0, F.floor(F.col("k") / 30)).alias("window"))
    layout = Layout(sensors=["view"], effectors=[Effector("unit", "x", {})], environment={"window": "window"})
    out = uncontrolled_segments(rows, layout, 21_600, 3)
    return out.groupBy("site_id", "sensor", "segment_id").agg(F.count(F.lit(1)).alias("n"))


def _segments(spark, sf):
    s = v.states(spark, sf).withColumns({"temp": F.col("value"), "outdoor_best": F.col("k").cast("double")})
    return sp.gap_segments(s, SITE_ROWS, 3_600, 4).withColumn("sensor", F.lit("all"))


SEGMENTS = f"""{v.STATES}, l AS (SELECT *, lag(ts) OVER (PARTITION BY site_id ORDER BY ts, event_id) AS prev FROM states_v),
s0 AS (SELECT site_id, ts, event_id, value AS temp, CAST(k AS DOUBLE) AS outdoor, CAST(sum(CASE WHEN epoch_us(ts) - epoch_us(prev) > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY ts, event_id) AS BIGINT) AS seg FROM l),
seg AS (SELECT * FROM s0 QUALIFY count(*) OVER (PARTITION BY site_id, seg) >= 4)"""


def tau_sql(rows: str, keys: str) -> str:
    """Three rounds of the candidate search over `rows(keys…, ts, temp, outdoor)`."""
    grid = first_grid()
    factor = grid[1] / grid[0]
    out = f""", hd AS (SELECT {keys}, min(ts) AS t0, arg_min(temp, ts) AS temp0, avg(outdoor) AS oo, count(*) AS n_rows FROM {rows} GROUP BY ALL HAVING abs(arg_min(temp, ts) - avg(outdoor)) >= 1),
nm AS (SELECT {keys}, n_rows, (epoch_us(r.ts) - epoch_us(t0)) / CAST(1000000.0 AS DOUBLE) / 3600.0 AS h, (r.temp - oo) / (temp0 - oo) AS z FROM {rows} r JOIN hd USING ({keys})),
c0 AS (SELECT unnest([{', '.join(repr(c) for c in grid)}]::DOUBLE[]) AS tau), e0 AS (SELECT {keys}, n_rows, tau, sum((z - exp(-h / tau)) * (z - exp(-h / tau))) AS sse FROM nm CROSS JOIN c0 GROUP BY ALL),
b0 AS (SELECT {keys}, n_rows, arg_min(tau, (sse, tau)) AS tau, min(sse) AS sse FROM e0 GROUP BY ALL)"""
    for i in (1, 2):
        scale = [float(factor ** (2.0 * j / (POINTS - 1) - 1.0)) for j in range(POINTS)]
        out += f""", c{i} AS (SELECT b.{keys.replace(', ', ', b.')}, greatest(1.0, least(500.0, b.tau * f.f)) AS tau FROM b{i - 1} b CROSS JOIN (SELECT unnest([{', '.join(repr(x) for x in scale)}]::DOUBLE[]) AS f) f),
e{i} AS (SELECT {keys}, n_rows, c.tau, sum((z - exp(-h / c.tau)) * (z - exp(-h / c.tau))) AS sse FROM nm JOIN (SELECT DISTINCT * FROM c{i}) c USING ({keys}) GROUP BY ALL),
b{i} AS (SELECT {keys}, n_rows, arg_min(tau, (sse, tau)) AS tau, min(sse) AS sse FROM e{i} GROUP BY ALL)"""
        factor = factor ** (2.0 / (POINTS - 1))
    return out


@query("tau_grid_fit", f"WITH {SEGMENTS}" + tau_sql("seg", "site_id, seg") + " SELECT site_id, seg AS segment_id, n_rows, round(tau, 3) AS tau, round(sse, 5) AS sse FROM b2")
def tau_grid_fit(spark, sf):
    out = fit_segments(_segments(spark, sf), ["site_id", "segment_id"])
    return out.select("site_id", "segment_id", "n_rows", F.round("tau", 3).alias("tau"), F.round("sse", 5).alias("sse"))


@query("sensor_taus", f"WITH {SEGMENTS}" + tau_sql("seg", "site_id, seg") + """, m AS (SELECT site_id, tau, sum(n_rows) AS w FROM b2 GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY site_id ORDER BY tau) AS cum, sum(w) OVER (PARTITION BY site_id) AS total FROM m),
md AS (SELECT site_id, round(min(tau), 1) AS tau FROM c WHERE cum >= total / 2.0 GROUP BY 1), n AS (SELECT site_id, count(*) AS n FROM b2 GROUP BY 1), ss AS (SELECT DISTINCT site_id, u.s AS sensor FROM states_v CROSS JOIN (VALUES ('all'), ('none')) u(s))
SELECT ss.site_id, ss.sensor, coalesce(CASE WHEN ss.sensor = 'all' THEN md.tau END, 45.0) AS tau_base, CAST(coalesce(CASE WHEN ss.sensor = 'all' THEN n.n END, 0) AS INTEGER) AS n_segments FROM ss LEFT JOIN md ON md.site_id = ss.site_id LEFT JOIN n ON n.site_id = ss.site_id""")
def sensor_taus_query(spark, sf):
    fits = fit_segments(_segments(spark, sf), ["site_id", "sensor", "segment_id"])
    sensors = v.sites(spark, sf).select("site_id", F.explode(F.array(F.lit("all"), F.lit("none"))).alias("sensor"), F.lit(45.0).alias("default_tau"))
    return sensor_taus(fits, sensors)


RUNS_SQL = f"""{v.STATES}, x AS (SELECT *, value > 70 AS state, lag(value > 70) OVER (PARTITION BY site_id ORDER BY ts, event_id) AS ps, row_number() OVER (PARTITION BY site_id ORDER BY ts, event_id) AS rn FROM states_v),
r0 AS (SELECT site_id, ts, value AS temp, CAST(k AS DOUBLE) AS outdoor, state, CAST(sum(CASE WHEN rn = 1 OR state <> ps THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY ts, event_id) AS BIGINT) AS run_no FROM x)"""


@query("sealed_ventilated", f"WITH {RUNS_SQL}" + tau_sql("r0", "site_id, run_no") + """, sp AS (SELECT site_id, run_no, bool_and(state) AS state, min(ts) AS st FROM r0 GROUP BY 1, 2), f AS (SELECT b2.site_id, sp.state, arg_min(b2.tau, sp.st) AS tau FROM b2 JOIN sp USING (site_id, run_no) WHERE n_rows >= 4 GROUP BY 1, 2),
w AS (SELECT site_id, round(max(tau) FILTER (WHERE NOT state), 1) AS sealed, round(max(tau) FILTER (WHERE state), 1) AS fv FROM f GROUP BY 1), t AS (SELECT site_id, fv / sealed AS ratio FROM w WHERE fv IS NOT NULL AND sealed IS NOT NULL)
SELECT w.site_id, sealed, coalesce(fv, round(sealed * coalesce(ratio, 0.44), 1)) AS ventilated, fv IS NULL AS estimated FROM w LEFT JOIN t ON t.site_id = w.site_id""")
def sealed_ventilated(spark, sf):
    s = v.states(spark, sf).withColumns({"state": F.col("value") > 70, "sensor": F.lit("all"), "temp": F.col("value"), "outdoor_best": F.col("k").cast("double")})
    track = Track(("site_id", "sensor"), "ts", ("event_id",))
    linked = sp.previous(s, track, {"__p": F.col("state"), "__any": F.lit(1)}, keep_chunk=True)
    changed = F.col("__any").isNull() | ~F.col("state").eqNullSafe(F.col("__p"))
    rows = sp.carry(linked, track, total={"run_no": changed.cast("bigint")})
    out = sealed_and_ventilated(rows, sp.state_spans(s, track, "state"), min_rows=4)
    return out.select("site_id", "sealed", "ventilated", "estimated")


def _two(spark, sf):
    """Design rows with two features, one scaled: the properties number and the hour."""
    s = v.states(spark, sf)
    return s.select("site_id", F.col("name").alias("sensor"), "ts", F.array(F.col("k").cast("double"), F.hour("ts").cast("double")).alias("x"), F.col("value").alias("y"))


SUMS = f"""{v.STATES}, z AS (SELECT site_id, name AS sensor, CAST(k AS DOUBLE) AS a, CAST(date_part('hour', ts) AS DOUBLE) AS b, value AS y FROM states_v),
m AS (SELECT site_id, sensor, CAST(count(*) AS DOUBLE) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS "by", sum(y * y) AS yy, sum(a) AS sa, sum(b) AS sb, sum(y) AS sy FROM z GROUP BY 1, 2)"""


@query("gram_sums", f"WITH {SUMS} SELECT site_id, sensor, aa, ab, bb, round(ay, 4) AS ay, round(yy, 4) AS yy, n FROM m")
def gram_sums(spark, sf):
    out = gram(_two(spark, sf), ["site_id", "sensor"])
    at = lambda i: F.element_at("g", i + 1)
    return out.select("site_id", "sensor", at(0).alias("aa"), at(1).alias("ab"), at(5).alias("bb"), F.round(at(3), 4).alias("ay"), F.round(at(15), 4).alias("yy"), at(10).alias("n"))


RIDGE = f"""WITH {SUMS}, q AS (SELECT *, sqrt(bb / n - (sb / n) * (sb / n)) AS sd, 0.01 * n AS lam FROM m WHERE n >= 20), q2 AS (SELECT *, ab / sd AS "B", bb / sd / sd AS "C", "by" / sd AS w FROM q),
d AS (SELECT *, (aa + lam) * ("C" + lam) - "B" * "B" AS det FROM q2), f AS (SELECT *, (("C" + lam) * ay - "B" * w) / det AS ba, ((aa + lam) * w - "B" * ay) / det / sd AS bbeta FROM d),
e AS (SELECT *, yy - 2 * (ba * ay + bbeta * "by") + ba * ba * aa + 2 * ba * bbeta * ab + bbeta * bbeta * bb AS sse FROM f),
va AS (SELECT *, "B" / ("C" + 0.001 * n) AS g1, "B" / (aa + 0.001 * n) AS g2, sse / (n - 2) AS s2 FROM e)
SELECT site_id, sensor, CAST(n AS BIGINT) AS n, round(ba, 6) AS beta_a, round(bbeta, 6) AS beta_b, round(ba / sqrt(s2 * ("C" + lam) / det), 5) AS t_a, round(bbeta / (sqrt(s2 * (aa + lam) / det) / sd), 5) AS t_b, round(1 - sse / (yy - sy * sy / n), 6) AS r_squared,
round(1 / (1 - least(1 - (aa - 2 * g1 * "B" + g1 * g1 * "C") / (aa - sa * sa / n), 0.9999)), 6) AS vif_a, round(1 / (1 - least(1 - ("C" - 2 * g2 * "B" + g2 * g2 * aa) / ("C" - (sb / sd) * (sb / sd) / n), 0.9999)), 6) AS vif_b FROM va"""


@query("ridge_two", RIDGE)
def ridge_two(spark, sf):
    fits = rg.ridge(_two(spark, sf), ["lag_a", "solar_b"], min_rows=20)
    pick = lambda c, i, d=6: F.round(F.element_at(c, i), d)
    return fits.select("site_id", "sensor", "n", pick("beta", 1).alias("beta_a"), pick("beta", 2).alias("beta_b"), pick("t", 1, 5).alias("t_a"), pick("t", 2, 5).alias("t_b"),
                       v.r6("r_squared").alias("r_squared"), pick("vif", 1).alias("vif_a"), pick("vif", 2).alias("vif_b"))


@query("ridge_residuals", RIDGE.replace("SELECT site_id, sensor, CAST(n AS BIGINT) AS n, round(ba", ", unused AS (SELECT site_id, sensor, CAST(n AS BIGINT) AS n, round(ba") + """), rs AS (SELECT z.site_id, z.sensor, s.ts, z.y - z.a * va.ba - z.b * va.bbeta AS e FROM (SELECT site_id, name AS sensor, ts, CAST(k AS DOUBLE) AS a, CAST(date_part('hour', ts) AS DOUBLE) AS b, value AS y, event_id FROM states_v) z JOIN states_v s ON s.event_id = z.event_id JOIN va ON va.site_id = z.site_id AND va.sensor = z.sensor),
dl AS (SELECT *, e - lag(e) OVER (PARTITION BY site_id, sensor ORDER BY ts) AS df FROM rs) SELECT site_id, sensor, round(sum(df * df) / sum(e * e), 6) AS durbin_watson FROM dl GROUP BY 1, 2""")
def ridge_residuals(spark, sf):
    design = _two(spark, sf)
    fits = rg.ridge(design, ["lag_a", "solar_b"], min_rows=20)
    out = sp.durbin_watson(rg.with_residuals(design, fits), Track(("site_id", "sensor")), "residual")
    return out.withColumn("durbin_watson", v.r6("durbin_watson"))


HOLDOUT = f"""WITH {SUMS.replace("value AS y FROM states_v)", "value AS y, event_id % 5 = 0 AS held FROM states_v)")}, q AS (SELECT site_id, sensor, sqrt(bb / n - (sb / n) * (sb / n)) AS sd, 0.01 * n AS lam FROM m WHERE n >= 50),
s AS (SELECT site_id, sensor, held, CAST(count(*) AS DOUBLE) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS "by", sum(y * y) AS yy FROM z GROUP BY 1, 2, 3),
t AS (SELECT s.*, q.sd, q.lam, ab / sd AS "B", bb / sd / sd AS "C", "by" / sd AS w FROM s JOIN q USING (site_id, sensor) WHERE NOT held),
f AS (SELECT *, (("C" + lam) * ay - "B" * w) / ((aa + lam) * ("C" + lam) - "B" * "B") AS p, ((aa + lam) * w - "B" * ay) / ((aa + lam) * ("C" + lam) - "B" * "B") / sd AS r FROM t),
e AS (SELECT f.site_id, f.sensor, sqrt((f.yy - 2 * (p * f.ay + r * f."by") + p * p * f.aa + 2 * p * r * f.ab + r * r * f.bb) / f.n) AS i, sqrt((v.yy - 2 * (p * v.ay + r * v."by") + p * p * v.aa + 2 * p * r * v.ab + r * r * v.bb) / v.n) AS o FROM f JOIN s v ON v.site_id = f.site_id AND v.sensor = f.sensor AND v.held)
SELECT site_id, sensor, round(i, 6) AS in_rmse, round(o, 6) AS out_rmse, round((o - i) / i, 6) AS degradation FROM e"""


@query("holdout_rmse", HOLDOUT)
def holdout_rmse(spark, sf):
    s = v.states(spark, sf)
    design = s.select("site_id", F.col("name").alias("sensor"), "ts", F.array(F.col("k").cast("double"), F.hour("ts").cast("double")).alias("x"), F.col("value").alias("y"), "event_id")
    fits = rg.ridge(design, ["lag_a", "solar_b"], min_rows=20)
    out = rg.holdout(design, fits, min_rows=50, held=F.col("event_id") % 5 == 0)
    return out.select("site_id", "sensor", *[v.r6(c).alias(c) for c in ("in_rmse", "out_rmse", "degradation")])


DESIGN_LAYOUT = Layout(sensors=["view"], effectors=[Effector("unit", "unit_mode", {"low": 0.5, "high": 1.0}, 30)], environment={"window": "window", "blind": "shade"}, zone="America/Phoenix")
DESIGN_LAGS = [f"lag_unit_{bin_label(start, end)}" for start, end in lag_bins(30)]
DESIGN = f"""WITH {v.STATES}, n AS (SELECT site_id, CAST(count(*) FILTER (WHERE k % 2 = 0) AS DOUBLE) AS w, CAST(count(*) FILTER (WHERE k % 5 = 0) AS DOUBLE) AS b FROM states_v GROUP BY 1),
r AS (SELECT s.*, k - value AS gap, CASE WHEN n.w >= 50 AND k % 2 = 0 THEN 1.0 ELSE 0.0 END AS win, CASE WHEN n.b >= 50 AND k % 5 = 0 THEN 1.0 ELSE 0.0 END AS blind,
(date_part('hour', l) + date_part('minute', l) / 60.0) * {2 * math.pi / 24!r} AS a FROM (SELECT *, ts - INTERVAL 7 HOUR AS l FROM states_v) s JOIN n ON n.site_id = s.site_id WHERE k % 11 <> 0)
SELECT site_id, name AS sensor, epoch_us(ts) AS ts_us, {", ".join(f"round(k * {i + 1} / 10.0, 6) AS {c}" for i, c in enumerate(DESIGN_LAGS))},
round(gap * gap * sign(gap), 6) AS weather_dt2, round(CASE WHEN k % 3 <> 0 THEN k ELSE 0 END * gap, 6) AS weather_wind_dt, round(k / 7.0, 6) AS weather_dtout_dt,
round(sin(a), 6) AS tod_sin1, round(cos(a), 6) AS tod_cos1, round(sin(2 * a), 6) AS tod_sin2, round(cos(2 * a), 6) AS tod_cos2,
round(win * gap, 6) AS adv_tau_window, round(k / 100.0, 6) AS solar_elev, round(blind * k / 100.0, 6) AS adv_solar_blind, round(value / 8.0 - gap / (40.0 + site_id), 6) AS y FROM r"""


@query("design_rows", DESIGN)
def design_rows(spark, sf):
    """Regression rows with every kind of feature; a row without a rate is left out."""
    k = F.col("k").cast("double")
    rows = v.states(spark, sf).select(
        "site_id", F.col("name").alias("sensor"), "ts", F.col("value").alias("temp"), k.alias("outdoor_best"), (k / 7).alias("outdoor_rate"), F.when(F.col("k") % 3 != 0, k).alias("wind_speed"),
        (k / 100).alias("solar"), F.when(F.col("k") % 11 != 0, F.col("value") / 8).alias("rate"), (F.col("k") % 2 == 0).cast("double").alias("window"), (F.col("k") % 5 == 0).cast("double").alias("blind"),
        *[(k * (i + 1) / 10).alias(c) for i, c in enumerate(DESIGN_LAGS)])
    taus = rows.select("site_id", "sensor").distinct().withColumn("tau_base", F.col("site_id") + 40.0)
    out, features = design(rows, taus, DESIGN_LAYOUT)
    return out.select("site_id", "sensor", v.us("ts").alias("ts_us"), *[F.round(F.col("x")[i], 6).alias(c) for i, c in enumerate(features)], v.r6("y").alias("y"))


BLOCKS, REPLICATES = 32, 50
BOOTSTRAP = f"""WITH {SUMS.replace("value AS y FROM states_v)", f"value AS y, event_id % {BLOCKS} AS blk FROM states_v)")}, q AS (SELECT site_id, sensor, sqrt(bb / n - (sb / n) * (sb / n)) AS sd, 0.01 * n AS lam FROM m WHERE n >= 50),
b AS (SELECT site_id, sensor, blk, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS "by" FROM z GROUP BY 1, 2, 3),
x0 AS (SELECT (i // {BLOCKS}) AS rep, ((i + 1)::UBIGINT * 2654435761::UBIGINT) % 4294967296::UBIGINT AS x FROM range({BLOCKS * REPLICATES}) t(i)),
x1 AS (SELECT rep, (xor(x, x >> 15) * 2246822519::UBIGINT) % 4294967296::UBIGINT AS x FROM x0),
w AS (SELECT rep, (xor(x, x >> 13) % {BLOCKS}::UBIGINT)::BIGINT AS blk, CAST(count(*) AS DOUBLE) AS w FROM x1 GROUP BY 1, 2),
g AS (SELECT site_id, sensor, rep, sum(w * aa) AS aa, sum(w * ab) AS ab, sum(w * bb) AS bb, sum(w * ay) AS ay, sum(w * "by") AS "by" FROM b JOIN w ON w.blk = b.blk GROUP BY 1, 2, 3),
t AS (SELECT g.site_id, g.sensor, rep, aa, ay, sd, lam, ab / sd AS "B", bb / sd / sd AS "C", "by" / sd AS w FROM g JOIN q USING (site_id, sensor)),
f AS (SELECT site_id, sensor, (("C" + lam) * ay - "B" * w) / ((aa + lam) * ("C" + lam) - "B" * "B") AS p, ((aa + lam) * w - "B" * ay) / ((aa + lam) * ("C" + lam) - "B" * "B") / sd AS r FROM t),
c AS (SELECT site_id, sensor, 'lag_a' AS feature, avg(p) AS mean, stddev_pop(p) AS sd FROM f GROUP BY 1, 2 UNION ALL SELECT site_id, sensor, 'solar_b', avg(r), stddev_pop(r) FROM f GROUP BY 1, 2)
SELECT site_id, sensor, feature, round(mean, 6) AS mean_beta, round(sd, 6) AS sd_beta, CASE WHEN abs(mean) > 0.01 THEN round(sd / abs(mean), 4) END AS cv FROM c"""


@query("bootstrap_cv", BOOTSTRAP)
def bootstrap_cv(spark, sf):
    s = v.states(spark, sf)
    design = s.select("site_id", F.col("name").alias("sensor"), "ts", F.array(F.col("k").cast("double"), F.hour("ts").cast("double")).alias("x"), F.col("value").alias("y"), "event_id")
    fits = rg.ridge(design, ["lag_a", "solar_b"], min_rows=20)
    out = rg.bootstrap_cv(design, fits, ["lag_a", "solar_b"], min_rows=50, replicates=REPLICATES, blocks=BLOCKS, block=F.col("event_id") % BLOCKS)
    return out.select("site_id", "sensor", "feature", v.r6("mean_beta").alias("mean_beta"), v.r6("sd_beta").alias("sd_beta"), F.when(F.abs("mean_beta") > 0.01, F.round("cv", 4)).alias("cv"))


@query("fit_health")
def fit_health(spark, sf):
    """Readings to graded fits over every site."""
    wide = v.filled(spark, sf)
    mode = F.when(F.col("error") > 60, "high").when(F.col("error") > 30, "low").otherwise("off")
    wide = wide.withColumns({"unit_mode": mode, "window": (F.col("signup") > 60).cast("double")})
    layout = Layout(sensors=["view"], effectors=[Effector("unit", "unit_mode", {"low": 0.5, "high": 1.0}, 90)], environment={"window": "window"},
                    outdoor_sensor="purchase", weather_outdoor="click", step_seconds=v.HOUR)
    fit = fit_sites(wide, layout, min_segment_rows=3, gap_seconds=7_200, min_rows=100, holdout_rows=200, replicates=20)
    return fit.health.select("site_id", "sensor", "tau_base", "n_segments", v.r6("r_squared").alias("r_squared"), v.r6("durbin_watson").alias("durbin_watson"), "n_gains", "grade")


COEFS = """coef_v AS (SELECT l_suppkey % 16 AS site_id, 's' || l_linenumber AS sensor, l_partkey % 24 AS i, (CAST(sum(l_quantity) AS BIGINT) % 601 - 300) / CAST(1000.0 AS DOUBLE) AS beta, (CAST(sum(l_quantity) AS BIGINT) % 83 - 41) / CAST(10.0 AS DOUBLE) AS t FROM lineitem GROUP BY 1, 2, 3)"""


def _coefs(spark, sf):
    """Coefficient rows: features 0-11 are lag bins of three devices, 12-17 exchange and 18-23 solar effects."""
    l = v.table(spark, sf, "lineitem")
    q = l.groupBy((F.col("l_suppkey") % 16).alias("site_id"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("sensor"), (F.col("l_partkey") % 24).alias("i")).agg(F.sum("l_quantity").cast("bigint").alias("q"))
    i = F.col("i")
    bins = F.array(*[F.lit(b) for b in ("0_15", "15_30", "30_60", "60_90")])
    lag = F.concat(F.lit("lag_e_"), F.floor(i / 4).cast("string"), F.lit("_"), F.element_at(bins, (i % 4 + 1).cast("int")))
    name = F.when(i < 12, lag).when(i < 18, F.concat(F.lit("adv_tau_w"), i.cast("string"))).otherwise(F.concat(F.lit("adv_solar_w"), i.cast("string")))
    return q.select("site_id", "sensor", i.cast("int").alias("feature_no"), name.alias("feature"), ((F.col("q") % 601 - 300) / 1000.0).alias("beta"), ((F.col("q") % 83 - 41) / 10.0).alias("t"))


@query("effector_gains", f"WITH {COEFS}, g AS (SELECT site_id, sensor, i // 4 AS e, sum(beta) AS gain, arg_max(i % 4, (abs(beta), -i)) AS b, arg_max(t, (abs(beta), -i)) AS t FROM coef_v WHERE i < 12 GROUP BY 1, 2, 3) SELECT site_id, sensor, 'e_' || e AS effector, round(gain, 4) AS gain_f_per_hour, [7.5, 22.5, 45.0, 75.0][b + 1] AS best_lag_minutes, round(t, 2) AS t_statistic, abs(gain) < 0.05 AND abs(t) < 2 AS negligible FROM g")
def effector_gains(spark, sf):
    return g.effector_gains(_coefs(spark, sf))


@query("environment_betas", f"WITH {COEFS} SELECT site_id, sensor, 'w' || i AS device, CASE WHEN i < 18 THEN 'tau' ELSE 'solar' END AS kind, round(beta, CASE WHEN i < 18 THEN 6 ELSE 4 END) AS beta, abs(t) > 3 AS unstable FROM coef_v WHERE i >= 12 AND abs(t) >= 2 AND (i >= 18 OR beta > 0)")
def environment_betas(spark, sf):
    coefs = _coefs(spark, sf)
    cvs = coefs.select("site_id", "sensor", "feature", (F.abs("t") / 3).alias("cv"))
    return g.environment_betas(coefs, cvs)


def _betas(spark, sf):
    coefs = _coefs(spark, sf)
    return g.environment_betas(coefs)


TAUS = "tau_v AS (SELECT l_suppkey % 16 AS site_id, 's' || l_linenumber AS sensor, CAST(sum(l_quantity) AS BIGINT) % 100 + CAST(1.5 AS DOUBLE) AS tau_base FROM lineitem WHERE l_suppkey % 16 <> 5 GROUP BY 1, 2)"


def _taus(spark, sf):
    l = v.table(spark, sf, "lineitem").filter(F.col("l_suppkey") % 16 != 5)
    return l.groupBy((F.col("l_suppkey") % 16).alias("site_id"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("sensor")).agg((F.sum("l_quantity").cast("bigint") % 100 + 1.5).alias("tau_base"))


@query("result_issues", f"""WITH {COEFS}, {TAUS}, {v.GAINS}, bt AS (SELECT site_id, sensor, 'w' || i AS device, i, round(beta, CASE WHEN i < 18 THEN 6 ELSE 4 END) * 10 AS beta FROM coef_v WHERE i >= 12 AND abs(t) >= 2 AND (i >= 18 OR beta > 0)), gg AS (SELECT * FROM gains_v WHERE negligible OR site_id <> 7)
SELECT bt.site_id, 'env_tau_beta_magnitude' AS "check", bt.sensor, device, CASE WHEN 1.0 / (1.0 / tau_base + beta) < 1 THEN 'error' ELSE 'warning' END AS severity FROM bt JOIN tau_v t ON t.site_id = bt.site_id AND t.sensor = bt.sensor WHERE i < 18 AND beta > 2.0 / tau_base
UNION ALL SELECT bt.site_id, 'env_solar_beta_magnitude', bt.sensor, device, 'error' FROM bt LEFT JOIN tau_v t ON t.site_id = bt.site_id AND t.sensor = bt.sensor WHERE i >= 18 AND abs(beta) > greatest(coalesce(tau_base / 100.0, 0) * 2, 1)
UNION ALL SELECT DISTINCT g.site_id, 'no_taus', '', NULL, 'error' FROM gg g WHERE NOT EXISTS (SELECT 1 FROM tau_v t WHERE t.site_id = g.site_id)
UNION ALL SELECT DISTINCT u.site_id, 'no_gains', '', NULL, 'error' FROM (SELECT site_id FROM gg UNION SELECT site_id FROM tau_v) u WHERE NOT EXISTS (SELECT 1 FROM gg g WHERE g.site_id = u.site_id AND NOT g.negligible)""")
def result_issues(spark, sf):
    betas = _betas(spark, sf).withColumn("beta", F.col("beta") * 10)
    taus = _taus(spark, sf)
    solar = taus.select("site_id", "sensor", (F.col("tau_base") / 100.0).alias("gain"))
    gains = v.gains(spark, sf).filter(F.col("negligible") | (F.col("site_id") != 7))
    return g.result_issues(taus, betas, solar, gains).select("site_id", "check", "sensor", "device", "severity")


def _health(spark, sf):
    s = v.states(spark, sf)
    k = F.col("k")
    return s.select("site_id", F.col("event_id").cast("string").alias("sensor"), (F.col("value") / 1000.0).alias("r_squared"), (k / 200.0).alias("durbin_watson"), (k % 8).alias("n_segments"), (k % 5).alias("n_gains"),
                    F.when(k % 6 == 0, 1).otherwise(0).alias("n_unstable_kept"), F.when(k % 3 != 0, k / 250.0).alias("holdout_degradation"), (k % 17 == 0).alias("has_errors"))


HEALTH = f"""WITH {v.STATES}, d AS (SELECT site_id, event_id, value / 1000.0 AS r, k / CAST(200.0 AS DOUBLE) AS dw, k % 8 AS sg, k % 5 AS ng, k % 6 = 0 AS un, CASE WHEN k % 3 <> 0 THEN k / CAST(250.0 AS DOUBLE) END AS ho, k % 17 = 0 AS er FROM states_v),
gr AS (SELECT *, CASE WHEN sg = 0 OR er OR ng = 0 OR r < 0.02 THEN 'F' WHEN r >= 0.08 AND dw >= 0.2 AND sg >= 5 AND NOT un AND coalesce(ho <= 0.2, true) THEN 'A' WHEN r >= 0.04 AND dw >= 0.1 AND sg >= 3 AND coalesce(ho <= 0.35, true) THEN 'B' ELSE 'C' END AS grade FROM d)"""


@query("health_grade", HEALTH + """ SELECT event_id, grade, array_to_string(CASE WHEN sg = 0 THEN ['no segments'] WHEN er THEN ['validation errors'] WHEN ng = 0 OR r < 0.02 THEN [x FOR x IN [CASE WHEN ng = 0 THEN 'no significant gains' END, CASE WHEN r < 0.02 THEN 'low R2' END] IF x IS NOT NULL] WHEN grade = 'A' THEN []
ELSE [x FOR x IN [CASE WHEN r < 0.08 THEN 'low R2' END, CASE WHEN dw < 0.2 THEN 'low DW' END, CASE WHEN sg < 5 THEN 'few segments' END, CASE WHEN un THEN 'unstable kept' END, CASE WHEN ho > 0.2 THEN 'holdout worse' END] IF x IS NOT NULL] END, ',') AS notes FROM gr""")
def health_grade(spark, sf):
    out = g.health_grade(_health(spark, sf))
    return out.select(F.col("sensor").cast("bigint").alias("event_id"), "grade", F.array_join("notes", ",").alias("notes"))


@query("grade_rollup", HEALTH + ", la AS (SELECT s.site_id, s.name, g.grade FROM states_v s JOIN gr g ON g.event_id = s.event_id QUALIFY row_number() OVER (PARTITION BY s.site_id, s.name ORDER BY s.event_id DESC) = 1) SELECT site_id, grade, count(*) AS n_sensors, count(*) FILTER (WHERE grade IN ('C', 'F')) AS n_weak, max(CASE WHEN grade IN ('C', 'F') THEN name END) AS last_weak FROM la GROUP BY 1, 2")
def grade_rollup(spark, sf):
    """The newest diagnostics of every sensor (name) per site."""
    names = v.states(spark, sf).select(F.col("event_id").cast("string").alias("sensor"), "event_id", "name")
    newest = g.health_grade(_health(spark, sf)).join(names, ["sensor"]).groupBy("site_id", "name").agg(F.max_by("grade", "event_id").alias("grade"))
    out = agg.grade_rollup(newest.withColumnRenamed("name", "sensor"))
    return out.select("site_id", "grade", "n_sensors", F.size("weak_sensors").cast("bigint").alias("n_weak"), F.array_max("weak_sensors").alias("last_weak"))


PAIR = v.GAINS + ", o AS (SELECT * FROM gains_v WHERE best_lag_minutes < 60), nw AS (SELECT site_id, effector, sensor, gain_f_per_hour * CASE WHEN t_statistic > 0 THEN 1.2 ELSE 1.8 END AS gain_f_per_hour, negligible FROM gains_v WHERE best_lag_minutes > 0)"


def _pair(spark, sf):
    a = v.gains(spark, sf)
    new = a.filter(F.col("best_lag_minutes") > 0).withColumn("gain_f_per_hour", F.col("gain_f_per_hour") * F.when(F.col("t_statistic") > 0, 1.2).otherwise(1.8))
    return a.filter(F.col("best_lag_minutes") < 60), new


@query("gain_drift", f"WITH {PAIR}, j AS (SELECT coalesce(o.site_id, n.site_id) AS site_id, coalesce(o.effector, n.effector) AS effector, coalesce(o.sensor, n.sensor) AS sensor, coalesce(o.gain_f_per_hour, 0.0) AS ov, coalesce(n.gain_f_per_hour, 0.0) AS nv, CASE WHEN o.site_id IS NULL THEN 'new' WHEN n.site_id IS NULL THEN 'removed' ELSE 'both' END AS status FROM (SELECT * FROM o WHERE NOT negligible) o FULL OUTER JOIN (SELECT * FROM nw WHERE NOT negligible) n ON n.site_id = o.site_id AND n.effector = o.effector AND n.sensor = o.sensor) SELECT site_id, effector, sensor, round(ov, 6) AS old_value, round(nv, 6) AS new_value, status FROM j WHERE NOT (abs(ov) < 0.05 AND abs(nv) < 0.05) AND CASE WHEN abs(ov) > 1e-6 THEN abs(nv - ov) / abs(ov) > 0.5 ELSE abs(nv) > 0.05 END")
def gain_drift(spark, sf):
    out = g.gain_drift(*_pair(spark, sf))
    return out.select("site_id", "effector", "sensor", v.r6("old_value").alias("old_value"), v.r6("new_value").alias("new_value"), "status")


@query("fit_acceptance", f"WITH {TAUS}, {v.GAINS} SELECT DISTINCT site_id FROM tau_v WHERE site_id IN (SELECT site_id FROM gains_v WHERE NOT negligible AND (site_id <> 7 OR gain_f_per_hour > 99))")
def fit_acceptance(spark, sf):
    return g.acceptable_sites(_taus(spark, sf), v.gains(spark, sf).filter((F.col("site_id") != 7) | (F.col("gain_f_per_hour") > 99)))


def _summary_sql(name: str, rows: str, factor: float) -> str:
    return f"""r_{name} AS (SELECT *, row_number() OVER (PARTITION BY site_id, effector ORDER BY NOT negligible DESC, abs(gain_f_per_hour) DESC, sensor) AS rn FROM {rows}),
s_{name} AS (SELECT site_id, avg(abs(gain_f_per_hour)) FILTER (WHERE rn = 1 AND NOT negligible) AS md, avg(abs(gain_f_per_hour)) FILTER (WHERE rn > 1 AND NOT negligible) AS mc FROM r_{name} GROUP BY 1),
q_{name} AS (SELECT site_id, avg(value / 1000.0 * {factor}) AS r2, avg(k / CAST(200.0 AS DOUBLE)) AS dw FROM states_v GROUP BY 1),
x_{name} AS (SELECT q.site_id, q.r2, q.dw, coalesce(s.md, 0.0) AS md, coalesce(s.mc, 0.0) AS mc, CASE WHEN s.md > 0 THEN coalesce(s.mc, 0) / s.md ELSE 0.0 END AS ratio FROM q_{name} q LEFT JOIN s_{name} s ON s.site_id = q.site_id)"""


def _summary(spark, sf, gains, factor):
    quality = _health(spark, sf).withColumn("r_squared", F.col("r_squared") * factor)
    return g.experiment_summary(gains, quality)


@query("experiment_summary", f"WITH {v.STATES}, {PAIR}, {_summary_sql('o', 'o', 1.0)} SELECT site_id, round(r2, 6) AS mean_r2, round(dw, 6) AS mean_dw, round(md, 6) AS mean_direct, round(mc, 6) AS mean_cross, round(ratio, 6) AS cross_direct_ratio FROM x_o")
def experiment_summary(spark, sf):
    out = _summary(spark, sf, _pair(spark, sf)[0], 1.0)
    return out.select("site_id", *[v.r6(c).alias(c) for c in ("mean_r2", "mean_dw", "mean_direct", "mean_cross", "cross_direct_ratio")])


def _verdict(want: str, o: str, n: str) -> str:
    if want == "lower":
        return f"CASE WHEN {n} <= {o} THEN 'pass' ELSE 'fail' END"
    if want == "keep":
        return f"CASE WHEN {n} >= {o} * 0.9 THEN 'pass' ELSE 'fail' END"
    return f"CASE WHEN abs({n} - {o}) / greatest(abs({o}), 0.001) < 0.2 THEN 'pass' ELSE 'check' END"


@query("compare_experiments", f"WITH {v.STATES}, {PAIR}, {_summary_sql('o', 'o', 1.0)}, {_summary_sql('n', 'nw', 0.85)} " + " UNION ALL ".join(
    f"SELECT o.site_id, '{m}' AS metric, round(CASE WHEN o.{c} = 0 THEN NULL ELSE (n.{c} - o.{c}) / abs(o.{c}) * 100 END, 4) AS percent, {_verdict(w, f'o.{c}', f'n.{c}')} AS verdict FROM x_o o JOIN x_n n ON n.site_id = o.site_id"
    for m, c, w in (("mean_r2", "r2", "keep"), ("mean_direct", "md", "stable"), ("mean_cross", "mc", "lower"), ("cross_direct_ratio", "ratio", "lower"))))
def compare_experiments(spark, sf):
    old, new = _pair(spark, sf)
    out = g.compare_experiments(_summary(spark, sf, old, 1.0), _summary(spark, sf, new, 0.85))
    return out.filter(F.col("metric") != "mean_dw").select("site_id", "metric", F.round("percent", 4).alias("percent"), "verdict")


@query("cross_gain_movers", f"WITH {PAIR} SELECT o.site_id, o.effector, o.sensor, round(abs(n.gain_f_per_hour) - abs(o.gain_f_per_hour), 6) AS delta FROM o JOIN nw n ON n.site_id = o.site_id AND n.effector = o.effector AND n.sensor = o.sensor ORDER BY abs(n.gain_f_per_hour) - abs(o.gain_f_per_hour), o.site_id, o.effector, o.sensor LIMIT 15")
def cross_gain_movers(spark, sf):
    old, new = _pair(spark, sf)
    return g.cross_gain_movers(old, new).select("site_id", "effector", "sensor", v.r6("delta").alias("delta"))
