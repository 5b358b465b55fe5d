"""Ordered-series operators: keys, as-of matching, grids, smoothing, spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermofleet.functions.timekeys import add_seconds, round5
from thermofleet.harness import views as v
from thermofleet.harness.registry import query
from thermofleet.operators import aggregates as agg
from thermofleet.operators import asof as a
from thermofleet.operators import grid as g
from thermofleet.operators import smoothing as sm
from thermofleet.operators import spans as sp
from thermofleet.operators.track import Track, over_rows
from thermofleet.session import cut_lineage
from thermofleet.sources.readings import new_rows, slice_time, upsert_by_key

SERIES = Track(("site_id", "name"), "ts", ("event_id",))
SITE = Track(("site_id",))
ROUND5 = "make_timestamp(CAST(floor((floor(epoch_us(ts) / 60000000) + 2) / 5) AS BIGINT) * 300000000)"


def tick():
    return g.tick("ts", v.HOUR)


@query("round5_dedup", f"""WITH {v.READINGS}, k AS (SELECT *, {ROUND5} AS ts5 FROM readings_v)
SELECT site_id, name, epoch_us(ts5) AS ts_us, arg_min(value, event_id) AS value, min(event_id) AS event_id
FROM k GROUP BY site_id, name, ts5""")
def round5_dedup(spark, sf):
    keyed = v.readings(spark, sf).withColumn("ts", round5(F.col("ts")))
    first = sp.keep_first(keyed, ["site_id", "ts", "name"], "event_id")
    return first.select("site_id", "name", v.us("ts").alias("ts_us"), "value", "event_id")


@query("insert_or_ignore", f"""WITH {v.READINGS}, k AS (SELECT site_id, name, {ROUND5} AS ts5, value, event_id FROM readings_v),
stored AS (SELECT DISTINCT site_id, name, ts5 FROM k WHERE event_id % 3 = 0)
SELECT site_id, name, epoch_us(ts5) AS ts_us, arg_min(value, event_id) AS value FROM k
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.site_id = k.site_id AND s.name = k.name AND s.ts5 = k.ts5)
GROUP BY site_id, name, ts5""")
def insert_or_ignore(spark, sf):
    keyed = v.readings(spark, sf).withColumn("ts", round5(F.col("ts")))
    stored = keyed.filter(F.col("event_id") % 3 == 0)
    return new_rows(stored, keyed, arrival="event_id").select("site_id", "name", v.us("ts").alias("ts_us"), "value")


@query("upsert_rows", f"""WITH {v.READINGS}, u AS (SELECT site_id, event_id, value * 2 AS value FROM readings_v WHERE value > 50),
w AS (SELECT site_id, event_id, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS value FROM u)
SELECT site_id, event_id, value FROM readings_v r WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.site_id = r.site_id AND u.event_id = r.event_id)
UNION ALL SELECT site_id, event_id, value FROM w""")
def upsert_rows(spark, sf):
    """A third of the keys are updated twice; the later update counts."""
    base = v.readings(spark, sf).select("site_id", "event_id", "value")
    updates = base.filter(F.col("value") > 50).withColumns({"value": F.col("value") * 2, "arrival": F.lit(1)})
    again = updates.filter(F.col("event_id") % 3 == 0).withColumns({"value": F.col("value") + 1, "arrival": F.lit(2)})
    return upsert_by_key(base, updates.unionByName(again), ["site_id", "event_id"], "arrival")


@query("time_slice", f"""WITH {v.READINGS} SELECT site_id, name, count(*) AS n, epoch_us(min(ts)) AS first_us FROM readings_v
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-19 12:00:00' GROUP BY 1, 2""")
def time_slice(spark, sf):
    cut = slice_time(v.readings(spark, sf), F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-19 12:00:00").cast("timestamp"))
    return cut.groupBy("site_id", "name").agg(F.count(F.lit(1)).alias("n"), v.us(F.min("ts")).alias("first_us"))


@query("change_only", f"""WITH {v.READINGS}, b AS (SELECT site_id, name, event_id, ts, CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS value FROM readings_v),
l AS (SELECT *, lag(value) OVER w AS prev, row_number() OVER w AS rn FROM b WINDOW w AS (PARTITION BY site_id, name ORDER BY ts, event_id))
SELECT site_id, name, event_id, value FROM l WHERE rn = 1 OR value IS DISTINCT FROM prev""")
def change_only(spark, sf):
    level = F.floor(F.col("value") / 50).cast("string")
    return sp.change_only(v.readings(spark, sf).withColumn("value", level), SERIES).select("site_id", "name", "event_id", "value")


@query("keep_last", f"""WITH {v.READINGS} SELECT site_id, name, epoch_us(date_trunc('hour', ts)) AS ts_us, arg_max(value, event_id) AS value
FROM readings_v GROUP BY site_id, name, date_trunc('hour', ts)""")
def keep_last(spark, sf):
    keyed = v.readings(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    return sp.keep_last(keyed, ["site_id", "name", "ts"], "event_id").select("site_id", "name", v.us("ts").alias("ts_us"), "value")


def _sides(spark, sf):
    r = v.readings(spark, sf)
    left = r.select("site_id", add_seconds(F.col("ts"), 1_800).alias("ts"), "event_id")
    right = r.select("site_id", "ts", "value", F.col("event_id").alias("view_id"))
    return left, right


SIDES = (
    f"WITH {v.READINGS}, l AS (SELECT site_id, ts + INTERVAL 30 MINUTE AS ts, event_id FROM readings_v), "
    "r AS (SELECT site_id, ts, value, event_id AS view_id FROM readings_v)"
)


@query("asof_backward", SIDES + " SELECT l.site_id, l.event_id, r.value AS right_value, r.view_id AS right_view_id FROM l ASOF LEFT JOIN r ON l.site_id = r.site_id AND l.ts >= r.ts")
def asof_backward(spark, sf):
    left, right = _sides(spark, sf)
    return a.asof(left, right, ["site_id"], ["value", "view_id"]).select("site_id", "event_id", "right_value", "right_view_id")


@query("asof_forward", SIDES + " SELECT l.site_id, l.event_id, r.view_id AS right_view_id FROM l ASOF LEFT JOIN r ON l.site_id = r.site_id AND l.ts <= r.ts")
def asof_forward(spark, sf):
    left, right = _sides(spark, sf)
    return a.asof(left, right, ["site_id"], ["view_id"], direction="forward").select("site_id", "event_id", "right_view_id")


@query("asof_strict", f"WITH {v.READINGS} SELECT site_id, event_id, lag(event_id) OVER (PARTITION BY site_id ORDER BY ts) AS right_prev_id FROM readings_v")
def asof_strict(spark, sf):
    r = v.readings(spark, sf).select("site_id", "ts", "event_id")
    right = r.withColumnRenamed("event_id", "prev_id")
    return a.asof(r, right, ["site_id"], ["prev_id"], allow_exact=False).select("site_id", "event_id", "right_prev_id")


@query("asof_stale", SIDES + """, m AS (SELECT l.site_id, l.event_id, l.ts, r.ts AS rts, r.view_id FROM l ASOF LEFT JOIN r ON l.site_id = r.site_id AND l.ts >= r.ts)
SELECT site_id, event_id, CASE WHEN epoch_us(ts) - epoch_us(rts) <= 7200000000 THEN view_id END AS right_view_id FROM m""")
def asof_stale(spark, sf):
    left, right = _sides(spark, sf)
    return a.asof(left, right, ["site_id"], ["view_id"], tolerance_seconds=7200).select("site_id", "event_id", "right_view_id")


NEAREST = """, b AS (SELECT l.site_id, l.event_id, l.ts, r.ts AS bts, r.view_id AS bid FROM l ASOF LEFT JOIN r ON l.site_id = r.site_id AND l.ts >= r.ts),
n AS (SELECT b.*, r.ts AS fts, r.view_id AS fid FROM b ASOF LEFT JOIN r ON b.site_id = r.site_id AND b.ts <= r.ts),
c AS (SELECT *, epoch_us(ts) - epoch_us(bts) AS bg, epoch_us(fts) - epoch_us(ts) AS fg FROM n)"""


@query("nearest_tol", SIDES + NEAREST + """ SELECT site_id, event_id, CASE WHEN fid IS NULL OR bg <= fg THEN CASE WHEN bg <= 7200000000 THEN bid END
ELSE CASE WHEN fg <= 7200000000 THEN fid END END AS right_view_id FROM c""")
def nearest_tol(spark, sf):
    left, right = _sides(spark, sf)
    return a.nearest(left, right, ["site_id"], ["view_id"], tolerance_seconds=7200).select("site_id", "event_id", "right_view_id")


@query("forecast_horizons", SIDES.replace("l AS (SELECT site_id, ts + INTERVAL 30 MINUTE AS ts, event_id FROM readings_v", "l AS (SELECT site_id, ts + INTERVAL 30 MINUTE + to_hours(h.hours) AS ts, event_id, h.hours FROM readings_v CROSS JOIN (VALUES (1), (2), (4), (6), (12)) h(hours)")
    + NEAREST.replace("SELECT l.site_id, l.event_id,", "SELECT l.site_id, l.event_id, l.hours,")
    + """ SELECT site_id, event_id, hours || 'h' AS horizon, CASE WHEN fid IS NULL OR bg <= fg THEN CASE WHEN bg <= 5400000000 THEN bid END
ELSE CASE WHEN fg <= 5400000000 THEN fid END END AS forecast_view_id FROM c""")
def forecast_horizons(spark, sf):
    left, right = _sides(spark, sf)
    found = a.forecast_at_horizons(left, right.withColumnRenamed("ts", "target_ts"), [1, 2, 4, 6, 12], values=["view_id"])
    return found.select("site_id", "event_id", "horizon", "forecast_view_id")


MINUTE = "date_trunc('minute', ts)"


@query("lookup_actual", f"""WITH {v.READINGS}, o AS (SELECT site_id, {MINUTE} AS ts, max(value) AS value FROM readings_v GROUP BY 1, 2),
p AS (SELECT site_id, event_id, {MINUTE} + INTERVAL 1 HOUR AS target FROM readings_v),
m AS (SELECT p.site_id, p.event_id, o.value, row_number() OVER (PARTITION BY p.event_id ORDER BY CASE WHEN o.ts = p.target THEN 0 ELSE 1 END, o.ts) AS rn
FROM p JOIN o ON o.site_id = p.site_id AND abs(epoch_us(o.ts) - epoch_us(p.target)) < 180000000)
SELECT p.site_id, p.event_id, m.value AS actual FROM p LEFT JOIN m ON m.event_id = p.event_id AND m.rn = 1""")
def lookup_actual(spark, sf):
    r = v.readings(spark, sf).withColumn("ts", F.date_trunc("minute", "ts"))
    observed = r.groupBy("site_id", "ts").agg(F.max("value").alias("value"))
    asked = r.select("site_id", "event_id", add_seconds(F.col("ts"), 3600).alias("target_ts"))
    return a.lookup_actual(asked, observed, ["site_id"], "value").select("site_id", "event_id", "actual")


@query("around_k", f"""WITH {v.READINGS}, p AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts DESC, event_id DESC) AS n FROM readings_v WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'),
f AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts, event_id) AS n FROM readings_v WHERE ts > TIMESTAMP '2024-01-15 12:00:00')
SELECT site_id, event_id, CAST(1 - n AS INTEGER) AS "offset" FROM p WHERE n <= 5 UNION ALL SELECT site_id, event_id, CAST(n AS INTEGER) FROM f WHERE n <= 2""")
def around_k(spark, sf):
    point = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return a.around(v.readings(spark, sf), point, ["site_id"], 5, 2, tie=["event_id"]).select("site_id", "event_id", "offset")


@query("grid_ffill", f"""WITH {v.READINGS}, span AS (SELECT site_id, name, date_trunc('hour', min(ts)) AS lo, max(ts) AS hi FROM readings_v GROUP BY 1, 2),
t AS (SELECT site_id, name, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span)
SELECT t.site_id, t.name, epoch_us(t.ts) AS ts_us, r.value FROM t ASOF LEFT JOIN readings_v r ON t.site_id = r.site_id AND t.name = r.name AND t.ts >= r.ts""")
def grid_ffill(spark, sf):
    out = g.resample_ffill(v.readings(spark, sf), ["site_id", "name"], step_seconds=v.HOUR, tie=["event_id"])
    return out.select("site_id", "name", v.us("ts").alias("ts_us"), "value")


@query("sparse_ffill", f"WITH {v.FILLED} SELECT site_id, epoch_us(ts) AS ts_us, view, purchase FROM filled_v")
def sparse_ffill(spark, sf):
    return g.forward_fill(v.hourly(spark, sf), SITE, ["view", "purchase"]).select("site_id", v.us("ts").alias("ts_us"), "view", "purchase")


@query("interp_limit", f"""WITH {v.HOURLY}, p AS (SELECT site_id, ts, view, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS pos FROM hourly_v),
k AS (SELECT *, last_value(CASE WHEN view IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS p0, last_value(view IGNORE NULLS) OVER w AS v0,
first_value(CASE WHEN view IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS p1, first_value(view IGNORE NULLS) OVER f AS v1 FROM p
WINDOW w AS (PARTITION BY site_id ORDER BY ts ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY site_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT site_id, epoch_us(ts) AS ts_us, round(CASE WHEN view IS NOT NULL THEN view WHEN pos - p0 <= 4 THEN CASE WHEN p1 IS NULL THEN v0
ELSE v0 + (v1 - v0) / (p1 - p0) * (pos - p0) END END, 6) AS view FROM k""")
def interp_limit(spark, sf):
    out = g.interpolate(v.hourly(spark, sf), SITE, "view", 4, tick())
    return out.select("site_id", v.us("ts").alias("ts_us"), v.r6("view").alias("view"))


@query("central_diff", f"""WITH {v.FILLED}, d AS (SELECT site_id, ts, view, lead(view) OVER w AS n, lag(view) OVER w AS p,
row_number() OVER w AS i, count(*) OVER (PARTITION BY site_id) AS c FROM filled_v WINDOW w AS (PARTITION BY site_id ORDER BY ts))
SELECT site_id, epoch_us(ts) AS ts_us, round(CASE WHEN i > 1 AND i < c THEN (n - p) / 2.0 WHEN i < c THEN n - view WHEN i > 1 THEN view - p END, 6) AS rate FROM d""")
def central_diff(spark, sf):
    out = over_rows(v.filled(spark, sf), SITE, 1, 1, [lambda w: {"rate": sm.central_difference(w, "view", 1.0)}], tick())
    return out.select("site_id", v.us("ts").alias("ts_us"), v.r6("rate").alias("rate"))


@query("rolling_smooth", f"""WITH {v.HOURLY}, s AS (SELECT site_id, ts, CASE WHEN count(click) OVER w >= 2 THEN avg(click) OVER w END AS smooth
FROM hourly_v WINDOW w AS (PARTITION BY site_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT site_id, epoch_us(ts) AS ts_us, round(smooth, 6) AS smooth,
round((lead(smooth, 3) OVER o - lag(smooth, 3) OVER o) / 6.0, 6) AS rate FROM s WINDOW o AS (PARTITION BY site_id ORDER BY ts)""")
def rolling_smooth(spark, sf):
    steps = [lambda w: {"smooth": sm.rolling_mean(w, "click", 3, 2)}, lambda w: {"rate": sm.wide_difference(w, "smooth", 3, 1.0)}]
    out = over_rows(v.hourly(spark, sf), SITE, 6, 6, steps, tick())
    return out.select("site_id", v.us("ts").alias("ts_us"), v.r6("smooth").alias("smooth"), v.r6("rate").alias("rate"))


def _lag_sql() -> str:
    parts = [
        f"round(coalesce(sum(coalesce(error, 0)) OVER (PARTITION BY site_id ORDER BY ts ROWS BETWEEN {e - 1} PRECEDING AND {s} {'PRECEDING' if s else 'PRECEDING'}), 0) / {float(e - s)}, 6) AS lag_{sm.bin_label(s, e)}"
        for s, e in sm.lag_bins(90)
    ]
    return f"WITH {v.HOURLY} SELECT site_id, epoch_us(ts) AS ts_us, {', '.join(parts)} FROM hourly_v"


@query("lag_bins", _lag_sql())
def lag_bins(spark, sf):
    bins = sm.lag_bins(90)
    step = lambda w: {f"lag_{sm.bin_label(s, e)}": sm.lag_bin_mean(w, "error", s, e) for s, e in bins}
    out = over_rows(v.hourly(spark, sf), SITE, 18, 0, [step], tick())
    return out.select("site_id", v.us("ts").alias("ts_us"), *[v.r6(f"lag_{sm.bin_label(s, e)}").alias(f"lag_{sm.bin_label(s, e)}") for s, e in bins])


@query("future_targets", f"""WITH {v.FILLED} SELECT site_id, epoch_us(ts) AS ts_us, lead(view, 1) OVER w AS view_1, lead(view, 6) OVER w AS view_6
FROM filled_v WINDOW w AS (PARTITION BY site_id ORDER BY ts)""")
def future_targets(spark, sf):
    out = g.horizon_value(v.filled(spark, sf), ["site_id"], ["view"], [1, 6], v.HOUR)
    return out.select("site_id", v.us("ts").alias("ts_us"), F.col("view_t+1").alias("view_1"), F.col("view_t+6").alias("view_6"))


@query("rate_features", f"""WITH {v.FILLED} SELECT site_id, epoch_us(ts) AS ts_us, round(view - lag(view, 3) OVER w, 6) AS d3, round(view - lag(view, 12) OVER w, 6) AS d12,
round(view - 2 * lag(view, 1) OVER w + lag(view, 2) OVER w, 6) AS dd FROM filled_v WINDOW w AS (PARTITION BY site_id ORDER BY ts)""")
def rate_features(spark, sf):
    out = sm.difference_features(v.filled(spark, sf), SITE, "view", (3, 12), tick())
    return out.select("site_id", v.us("ts").alias("ts_us"), v.r6("view_d3").alias("d3"), v.r6("view_d12").alias("d12"), v.r6("view_dd").alias("dd"))


@query("rate_features_rows", f"""WITH {v.READINGS} SELECT site_id, name, event_id, round(value - lag(value, 3) OVER w, 6) AS d3,
round(value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w, 6) AS dd FROM readings_v WINDOW w AS (PARTITION BY site_id, name ORDER BY ts, event_id)""")
def rate_features_rows(spark, sf):
    out = sm.difference_features(v.readings(spark, sf), SERIES, "value", (3,))
    return out.select("site_id", "name", "event_id", v.r6("value_d3").alias("d3"), v.r6("value_dd").alias("dd"))


SEGMENTS = f"""WITH {v.READINGS}, l AS (SELECT *, lag(ts) OVER w AS prev FROM readings_v WINDOW w AS (PARTITION BY site_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(CASE WHEN epoch_us(ts) - epoch_us(prev) > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY ts, event_id) AS BIGINT) AS segment_id FROM l)"""
SITE_ROWS = Track(("site_id",), "ts", ("event_id",))


@query("gap_sessions", SEGMENTS + """ SELECT site_id, segment_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n_rows
FROM s GROUP BY 1, 2 HAVING count(*) >= 3""")
def gap_sessions(spark, sf):
    tagged = sp.gap_segments(v.readings(spark, sf), SITE_ROWS, 7200, 3)
    return sp.segment_summary(tagged, ["site_id"]).select("site_id", "segment_id", v.us("start_ts").alias("start_us"), v.us("end_ts").alias("end_us"), "n_rows")


@query("state_spans", f"""WITH {v.READINGS}, l AS (SELECT *, lag(name) OVER w AS prev, row_number() OVER w AS rn FROM readings_v WINDOW w AS (PARTITION BY site_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(CASE WHEN rn = 1 OR name <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY ts, event_id) AS BIGINT) AS run_no FROM l)
SELECT site_id, run_no, min(name) AS name, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n_rows FROM s GROUP BY 1, 2""")
def state_spans(spark, sf):
    out = sp.state_spans(v.readings(spark, sf), SITE_ROWS, "name")
    return out.select("site_id", "run_no", "name", v.us("start_ts").alias("start_us"), v.us("end_ts").alias("end_us"), "n_rows")


@query("mode_change_time", f"""WITH {v.READINGS}, l AS (SELECT *, lag(name) OVER w AS prev, row_number() OVER w AS rn FROM readings_v WINDOW w AS (PARTITION BY site_id ORDER BY ts, event_id))
SELECT site_id, event_id, epoch_us(last_value(CASE WHEN rn = 1 OR name <> prev THEN ts END IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY ts, event_id)) AS since_us FROM l""")
def mode_change_time(spark, sf):
    return sp.last_change_time(v.readings(spark, sf), SITE_ROWS, "name").select("site_id", "event_id", v.us("mode_since").alias("since_us"))


@query("durbin_watson", f"""WITH {v.READINGS}, l AS (SELECT site_id, name, value - 50 AS e, lag(value - 50) OVER (PARTITION BY site_id, name ORDER BY ts, event_id) AS p FROM readings_v)
SELECT site_id, name, round(coalesce(sum((e - p) * (e - p)), 0) / greatest(sum(e * e), 1e-30), 6) AS durbin_watson FROM l GROUP BY 1, 2""")
def durbin_watson(spark, sf):
    out = sp.durbin_watson(v.readings(spark, sf).withColumn("e", F.col("value") - 50), SERIES, "e")
    return out.select("site_id", "name", v.r6("durbin_watson").alias("durbin_watson"))


@query("tail_history", f"""WITH {v.READINGS} SELECT site_id, name, event_id, CAST(row_number() OVER (PARTITION BY site_id, name ORDER BY ts DESC, event_id DESC) AS INTEGER) AS age_rank FROM readings_v
QUALIFY age_rank <= 18""")
def tail_history(spark, sf):
    out = sp.tail_rows(v.readings(spark, sf), ["site_id", "name"], [F.col("ts"), F.col("event_id")])
    return out.select("site_id", "name", "event_id", "age_rank")


@query("fill_accuracy", f"""WITH {v.READINGS}, k AS (SELECT site_id, name, {ROUND5} AS ts, arg_min(value, event_id) AS value FROM readings_v GROUP BY 1, 2, 3),
span AS (SELECT site_id, name, date_trunc('hour', min(ts)) AS lo, max(ts) AS hi FROM k GROUP BY 1, 2),
t AS (SELECT site_id, name, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span),
f AS (SELECT t.site_id, t.name, t.ts, k.value FROM t ASOF LEFT JOIN k ON t.site_id = k.site_id AND t.name = k.name AND t.ts >= k.ts),
q AS (SELECT f.*, h.hours, f.ts + to_hours(h.hours) AS wanted FROM f CROSS JOIN (VALUES (1), (2), (4), (6)) h(hours) WHERE f.value IS NOT NULL),
b AS (SELECT q.*, k.ts AS bts, k.value AS bv FROM q ASOF LEFT JOIN k ON q.site_id = k.site_id AND q.name = k.name AND q.wanted >= k.ts),
n AS (SELECT b.*, k.ts AS fts, k.value AS fv FROM b ASOF LEFT JOIN k ON b.site_id = k.site_id AND b.name = k.name AND b.wanted <= k.ts),
c AS (SELECT *, epoch_us(wanted) - epoch_us(bts) AS bg, epoch_us(fts) - epoch_us(wanted) AS fg FROM n),
o AS (SELECT hours, value - CASE WHEN fts IS NULL OR bg <= fg THEN CASE WHEN bg <= 7200000000 THEN bv END ELSE CASE WHEN fg <= 7200000000 THEN fv END END AS error FROM c)
SELECT hours || 'h' AS horizon, round(avg(abs(error)), 3) AS mae, round(avg(error), 3) AS bias, count(*) AS n FROM o WHERE error IS NOT NULL GROUP BY 1""")
def fill_accuracy(spark, sf):
    """Readings -> five-minute keys -> first write wins -> hourly fill -> value near each horizon -> error report."""
    keyed = v.readings(spark, sf).withColumn("ts", round5(F.col("ts")))
    # The stored table feeds the grid, the fill and the match, so it is written once.
    stored = cut_lineage(sp.keep_first(keyed, ["site_id", "ts", "name"], "event_id"))
    series = ["site_id", "name"]
    fill = g.resample_ffill(stored, series, step_seconds=v.HOUR).filter(F.col("value").isNotNull())
    found = a.forecast_at_horizons(
        fill, stored.select(*series, F.col("ts").alias("target_ts"), F.col("value").alias("actual")), [1, 2, 4, 6], by=series,
        values=["actual"], tolerance_seconds=7200,
    )
    errors = found.select("horizon", (F.col("value") - F.col("forecast_actual")).alias("error"))
    return agg.accuracy_by_horizon(errors, ["horizon"])
