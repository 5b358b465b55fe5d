"""Training sets, splits, boosted trees, scenario scoring and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermofleet.harness import views as v
from thermofleet.harness.registry import query
from thermofleet.operators.aggregates import error_sets
from thermofleet.training import jobs as t

R = f"WITH {v.READINGS}"


@query("chronological_split", R + ", n AS (SELECT site_id, event_id, row_number() OVER (PARTITION BY site_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY site_id) AS c FROM readings_v) SELECT site_id, event_id, i <= floor(c * 0.8) AS is_train FROM n")
def chronological_split(spark, sf):
    return t.chronological_split(v.readings(spark, sf), tie=["event_id"]).select("site_id", "event_id", "is_train")


@query("every_third", R + ", n AS (SELECT site_id, event_id, row_number() OVER (PARTITION BY site_id ORDER BY ts, event_id) AS i FROM readings_v) SELECT site_id, event_id FROM n WHERE (i - 1) % 3 = 0")
def every_third(spark, sf):
    return t.every_nth(v.readings(spark, sf), 3, tie=["event_id"]).select("site_id", "event_id")


@query("training_rows", f"WITH {v.FILLED}, f AS (SELECT site_id, ts, view, lead(view, 2) OVER w AS t2, lead(click, 2) OVER w AS c2 FROM filled_v WINDOW w AS (PARTITION BY site_id ORDER BY ts)) SELECT site_id, epoch_us(ts) AS ts_us, view, t2, c2 FROM f WHERE t2 IS NOT NULL AND c2 IS NOT NULL")
def training_rows(spark, sf):
    out = t.training_set(v.filled(spark, sf), ["view", "click"], [2], v.HOUR).dropna(subset=["view_t+2", "click_t+2"])
    return out.select("site_id", v.us("ts").alias("ts_us"), "view", F.col("view_t+2").alias("t2"), F.col("click_t+2").alias("c2"))


@query("kept_targets", f"WITH {v.HOURLY}, c AS (SELECT site_id, avg(CASE WHEN view IS NULL THEN 0.0 ELSE 1.0 END) AS view, avg(CASE WHEN error IS NULL THEN 0.0 ELSE 1.0 END) AS error FROM hourly_v GROUP BY 1) SELECT site_id, 'view' AS column_name FROM c WHERE view >= 0.16 UNION ALL SELECT site_id, 'error' FROM c WHERE error >= 0.16")
def kept_targets(spark, sf):
    return t.kept_targets(v.hourly(spark, sf), ["view", "error"], 0.16).select("site_id", "column_name")


SCENARIOS = {"all_off": {"error": 0.0}, "heat": {"error": 1.0}, "both": {"error": 1.0, "signup": 5.0}}


@query("override_scenarios", f"WITH {v.FILLED}, s AS (SELECT f.site_id, f.ts, u.n AS scenario, coalesce(CAST(u.e AS DOUBLE), f.error) AS error, coalesce(CAST(u.s AS DOUBLE), f.signup) AS signup FROM filled_v f CROSS JOIN (VALUES ('all_off', 0.0, NULL), ('heat', 1.0, NULL), ('both', 1.0, 5.0)) u(n, e, s)) SELECT site_id, epoch_us(ts) AS ts_us, scenario, error, signup FROM s")
def override_scenarios(spark, sf):
    out = t.override_scenarios(v.filled(spark, sf), SCENARIOS)
    return out.select("site_id", v.us("ts").alias("ts_us"), "scenario", "error", "signup")


@query("scenario_deltas", f"WITH {v.FILLED}, s AS (SELECT f.site_id, f.ts, u.n AS scenario, coalesce(CAST(u.e AS DOUBLE), f.error) * 2 + coalesce(CAST(u.s AS DOUBLE), f.signup) AS p FROM filled_v f CROSS JOIN (VALUES ('all_off', 0.0, NULL), ('heat', 1.0, NULL), ('both', 1.0, 5.0)) u(n, e, s)) SELECT site_id, epoch_us(ts) AS ts_us, scenario, round(p - max(CASE WHEN scenario = 'all_off' THEN p END) OVER (PARTITION BY site_id, ts), 6) AS delta FROM s")
def scenario_deltas(spark, sf):
    scored = t.override_scenarios(v.filled(spark, sf), SCENARIOS).withColumn("p", F.col("error") * 2 + F.col("signup"))
    return t.scenario_deltas(scored, "p", ["site_id", "ts"]).select("site_id", v.us("ts").alias("ts_us"), "scenario", v.r6("delta").alias("delta"))


@query("backtest", R + """, o AS (SELECT site_id, name, date_trunc('minute', ts) AS ts, max(value) AS value FROM readings_v GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts, name) AS i FROM o),
p AS (SELECT site_id, name, ts, h.h, value, ts + to_minutes(5 * h.h) AS target FROM n CROSS JOIN (VALUES (12), (24)) h(h) WHERE (i - 1) % 3 = 0),
m AS (SELECT p.*, o.value AS actual, row_number() OVER (PARTITION BY p.site_id, p.name, p.ts, p.h ORDER BY CASE WHEN o.ts = p.target THEN 0 ELSE 1 END, o.ts) AS rn FROM p JOIN o ON o.site_id = p.site_id AND o.name = p.name AND abs(epoch_us(o.ts) - epoch_us(p.target)) < 180000000)
SELECT name AS room, h AS horizon_steps, round(sqrt(avg((value - actual) * (value - actual))), 6) AS rmse, round(avg(value - actual), 6) AS bias, count(*) AS n FROM m WHERE rn = 1 GROUP BY GROUPING SETS ((h), (name, h))""")
def backtest(spark, sf):
    r = v.readings(spark, sf).withColumn("ts", F.date_trunc("minute", "ts"))
    observed = r.groupBy("site_id", F.col("name").alias("room"), "ts").agg(F.max("value").alias("value"))
    picked = t.every_nth(observed, 3, tie=["room"])
    asked = picked.select("site_id", "room", "ts", F.col("value").alias("pred"), F.explode(F.array(F.lit(12), F.lit(24))).alias("horizon_steps"))
    out = error_sets(t.backtest(asked, observed), [["horizon_steps"], ["room", "horizon_steps"]])
    return out.select("room", "horizon_steps", v.r6("rmse").alias("rmse"), v.r6("bias").alias("bias"), "n")


@query("persistence_errors", f"""WITH {v.FILLED}, f AS (SELECT site_id, ts, view, click, lead(view, 2) OVER w AS view_2h, lead(click, 2) OVER w AS click_2h, row_number() OVER w AS i, count(*) OVER (PARTITION BY site_id) AS c FROM filled_v WINDOW w AS (PARTITION BY site_id ORDER BY ts)),
h AS (SELECT * FROM f WHERE i > floor(c * 0.8)), e AS (SELECT site_id, 'view_2h' AS target, view - view_2h AS d FROM h WHERE view_2h IS NOT NULL UNION ALL SELECT site_id, 'click_2h', click - click_2h FROM h WHERE click_2h IS NOT NULL)
SELECT site_id, target, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(abs(d)), 6) AS mae, count(*) AS n_val FROM e GROUP BY 1, 2""")
def persistence_errors(spark, sf):
    """The error report of a predictor that SQL can state: nothing changes in two hours."""
    rows = t.training_set(v.filled(spark, sf), ["view", "click"], [2], v.HOUR)
    rows = t.chronological_split(rows).withColumnsRenamed({"view_t+2": "view_2h", "click_t+2": "click_2h"})
    scored = rows.withColumns({"pred_view_2h": F.col("view"), "pred_click_2h": F.col("click")})
    out = t.errors(scored, ["view_2h", "click_2h"])
    return out.select("site_id", "target", v.r6("rmse").alias("rmse"), v.r6("mae").alias("mae"), "n_val")


@query("missing_features", f"WITH {v.HOURLY} SELECT site_id, CAST(count(*) FILTER (WHERE view IS NULL) AS DOUBLE) AS view, CAST(count(*) FILTER (WHERE error IS NULL) AS DOUBLE) AS error, CAST(count(*) AS DOUBLE) AS humidity FROM hourly_v GROUP BY 1")
def missing_features(spark, sf):
    """Scoring rows that lack a feature column altogether: it reads NULL and is marked missing everywhere."""
    marked = t.with_marks(v.hourly(spark, sf), ["view", "error", "humidity"])
    return marked.groupBy("site_id").agg(*[F.sum(f"{c}__missing").alias(c) for c in ("view", "error", "humidity")])


@query("gbt_errors")
def gbt_errors(spark, sf):
    """One boosted-tree model per target over every site, judged on the last fifth of each site's rows."""
    from thermofleet.session import cut_lineage

    features = ["view", "click", "error", "purchase", "signup"]
    rows = t.training_set(v.filled(spark, sf), ["view", "click"], [2], v.HOUR)
    rows = cut_lineage(t.chronological_split(rows).withColumnsRenamed({"view_t+2": "view_2h", "click_t+2": "click_2h"}))
    targets = ["view_2h", "click_2h"]
    models = t.train(rows, features, targets, rounds=5, depth=3)
    return t.errors(t.score(models, rows, features), targets)
