"""Ordered looks worked part by part from stored borders; a "day" here is a third of a month, and the second one comes last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermofleet.harness import views as v
from thermofleet.harness.registry import query
from thermofleet.operators import sketches as sk
from thermofleet.operators.daily import DailySeries
from thermofleet.session import scratch_path
from thermofleet.sources.readings import upsert_days

ROWS = f"WITH {v.READINGS}, x AS (SELECT site_id, name, ts, event_id, CASE WHEN event_id % 5 <> 0 THEN floor(value / 50) END AS value FROM readings_v)"
OVER = "PARTITION BY site_id, name ORDER BY ts, event_id"


def _third(ts):
    return F.make_date(F.year(ts), F.month(ts), F.least(F.floor((F.day(ts) - 1) / 10), F.lit(2)) * 10 + 1)


def _by_parts(spark, sf, look) -> DataFrame:
    """`look(series, rows, part)` of every part, put together; parts are stored in order but for the second."""
    rows = v.readings(spark, sf).withColumn("value", F.when(F.col("event_id") % 5 != 0, F.floor(F.col("value") / 50).cast("double")))
    series = DailySeries(scratch_path(spark, "daily"), ("site_id", "name"), tie=("event_id",), gap_seconds=6 * 3600,
                         day=_third)
    parts = [r[0].isoformat() for r in rows.select(series.day(F.col("ts")).alias("p")).distinct().orderBy("p").collect()]
    for part in [*parts[:1], *parts[2:], *parts[1:2]]:
        series.put(rows, part)
    return reduce(DataFrame.unionByName, [look(series, rows, p) for p in parts])


@query("daily_filled", ROWS + f" SELECT site_id, name, event_id, last_value(value IGNORE NULLS) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS value FROM x")
def daily_filled(spark, sf):
    return _by_parts(spark, sf, lambda s, r, p: s.filled(r, p)).select("site_id", "name", "event_id", "value")


@query("daily_compacted", ROWS + f", l AS (SELECT *, lag(value) OVER w AS prev, row_number() OVER w AS n FROM x WINDOW w AS ({OVER})) SELECT site_id, name, event_id, value FROM l WHERE n = 1 OR value IS DISTINCT FROM prev")
def daily_compacted(spark, sf):
    return _by_parts(spark, sf, lambda s, r, p: s.compacted(r, p)).select("site_id", "name", "event_id", "value")


@query("daily_segments", ROWS + f", l AS (SELECT *, lag(ts) OVER ({OVER}) AS prev FROM x) SELECT site_id, name, event_id, CAST(sum(CASE WHEN epoch_us(ts) - epoch_us(prev) > 21600000000 THEN 1 ELSE 0 END) OVER ({OVER}) AS BIGINT) AS segment_id FROM l")
def daily_segments(spark, sf):
    return _by_parts(spark, sf, lambda s, r, p: s.segmented(r, p)).select("site_id", "name", "event_id", "segment_id")


@query("daily_spans", ROWS + f""", l AS (SELECT *, lag(value) OVER w AS prev, row_number() OVER w AS n FROM x WINDOW w AS ({OVER})),
s AS (SELECT *, CAST(sum(CASE WHEN n = 1 OR value IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER ({OVER}) AS BIGINT) AS run_no FROM l)
SELECT site_id, name, run_no, any_value(value) AS value, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n_rows FROM s GROUP BY 1, 2, 3""")
def daily_spans(spark, sf):
    """A run over several parts comes with each of them; its longest row is the whole run."""
    out = _by_parts(spark, sf, lambda s, r, p: s.spans(r, p))
    whole = out.groupBy("site_id", "name", "run_no").agg(F.max_by(F.struct("value", "start_ts", "end_ts", "n_rows"), "n_rows").alias("r"))
    return whole.select("site_id", "name", "run_no", "r.value", v.us("r.start_ts").alias("start_us"), v.us("r.end_ts").alias("end_us"), "r.n_rows")


@query("daily_grid", ROWS + f""", span AS (SELECT site_id, name, date_trunc('hour', min(ts)) AS lo, max(ts) AS hi FROM x GROUP BY 1, 2),
t AS (SELECT site_id, name, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span), k AS (SELECT * FROM x WHERE value IS NOT NULL)
SELECT t.site_id, t.name, epoch_us(t.ts) AS ts_us, k.value FROM t ASOF LEFT JOIN k ON t.site_id = k.site_id AND t.name = k.name AND t.ts >= k.ts""")
def daily_grid(spark, sf):
    return _by_parts(spark, sf, lambda s, r, p: s.gridded(r, p, v.HOUR)).select("site_id", "name", v.us("ts").alias("ts_us"), "value")


@query("upsert_batches", f"""WITH {v.READINGS}, u AS (SELECT site_id, ts, event_id, CASE WHEN event_id % 6 = 0 THEN value + 1 WHEN event_id % 3 = 0 THEN value * 2 ELSE value END AS value FROM readings_v)
SELECT site_id, epoch_us(ts) AS ts_us, event_id, value FROM u""")
def upsert_batches(spark, sf):
    """Batch 1 lands everything, batch 2 updates a third, of which a half twice; batch 2 comes again and changes nothing."""
    path = scratch_path(spark, "upserts")
    rows = v.readings(spark, sf).select("site_id", "ts", "event_id", "value")
    third = rows.filter(F.col("event_id") % 3 == 0).withColumns({"value": F.col("value") * 2, "arrival": F.lit(1)})
    again = rows.filter(F.col("event_id") % 6 == 0).withColumns({"value": F.col("value") + 1, "arrival": F.lit(2)})
    upsert_days(rows, path, ["site_id", "ts", "event_id"], 1)
    upsert_days(third.unionByName(again), path, ["site_id", "ts", "event_id"], 2, "arrival")
    upsert_days(third.withColumn("value", F.lit(0.0)), path, ["site_id", "ts", "event_id"], 2, "arrival")
    return spark.read.parquet(path).select("site_id", v.us("ts").alias("ts_us"), "event_id", "value")


@query("sketched_stats", f"""WITH {v.READINGS}, r AS (SELECT * FROM readings_v WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25')
SELECT site_id, count(*) AS n_rows, count(DISTINCT event_id) AS n_items, min(value) AS least, max(value) AS greatest, true AS items_near, true AS ranks_near FROM r GROUP BY 1""")
def sketched_stats(spark, sf):
    """Sketches of days merged for a span, held against the exact numbers: distinct counts within 8 %, ranks within 3 %."""
    rows = v.readings(spark, sf)
    days = sk.day_sketches(rows, ["site_id"], F.col("event_id"), F.col("value"))
    found = sk.merged(days, ["site_id"], (0.25, 0.75), "2024-01-03", "2024-01-24").drop("n_rows", "least", "greatest")
    span = rows.filter(F.col("ts").cast("date").between(F.lit("2024-01-03").cast("date"), F.lit("2024-01-24").cast("date")))
    low, high = F.col("quantiles")[0], F.col("quantiles")[1]
    exact = span.join(found.select("site_id", low.alias("q1"), high.alias("q3")), "site_id").groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("exact_items"), F.min("value").alias("least"), F.max("value").alias("greatest"),
        *[F.avg((F.col("value") < F.col(q)).cast("double")).alias(f"below_{q}") for q in ("q1", "q3")], *[F.avg((F.col("value") <= F.col(q)).cast("double")).alias(f"upto_{q}") for q in ("q1", "q3")])
    near = lambda q, rank: (F.col(f"below_{q}") <= rank + 0.03) & (F.col(f"upto_{q}") >= rank - 0.03)
    return exact.join(found.select("site_id", "n_items"), "site_id").select(
        "site_id", "n_rows", F.col("exact_items").alias("n_items"), "least", "greatest",
        (F.abs(F.col("n_items") - F.col("exact_items")) <= F.greatest(0.08 * F.col("exact_items"), F.lit(2))).alias("items_near"), (near("q1", 0.25) & near("q3", 0.75)).alias("ranks_near"))
