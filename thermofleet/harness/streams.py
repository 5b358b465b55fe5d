"""Streaming jobs over events that land in several runs, some of them late; every run goes on from the state of the last.

A row lands with its half of the month; every seventh of the first half lands with the second, when its time has long passed.
A tick of no site lands last and moves the watermark past everything, so that the streams close what they hold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from thermofleet.functions.timekeys import add_seconds, round5
from thermofleet.harness import views as v
from thermofleet.harness.alerts import cooldown_scan  # noqa: F401  (shares its SQL)
from thermofleet.harness.registry import SQL, query
from thermofleet.harness.series import ROUND5
from thermofleet.harness.tables import _dims, _entity_states
from thermofleet.session import scratch_path
from thermofleet.sources.states import states_to_readings
from thermofleet.streaming import jobs as j
from thermofleet.streaming import ordered as o

LANDED = "site_id bigint, ts timestamp, name string, value double, event_id bigint"
RUNS = 2
DAYS = 15  # of events a run brings
TICK = -1  # the site that only ticks
FIRST_DAY = 19_723  # 2024-01-01
R = f"WITH {v.READINGS}"


def _run_of(ts, late):
    part = F.greatest(F.floor((F.unix_date(F.to_date(ts)) - FIRST_DAY) / DAYS), F.lit(0)) + F.when(late, 1).otherwise(0)
    return F.least(part, F.lit(RUNS - 1))


def _take_up(spark, stream, out, state, last):
    """Run what has landed; only behind the last run a batch without rows follows, for what the watermark has closed."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(last).lower())
    try:
        j.run_available(stream, out, state)
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")


def judged(slot_us: int, ts: str = "ts") -> str:
    """SQL: readings with `late`, told by the watermark their run began with (15 minutes behind all earlier runs)."""
    return f"""landed_v AS (SELECT site_id, name, value, event_id, {ts} AS ts, least(greatest(floor((epoch_us(r.ts) // 86400000000 - {FIRST_DAY}) / {DAYS}.0), 0) + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END, {RUNS - 1}) AS run FROM readings_v r),
mark_v AS (SELECT run, max(max(epoch_ms(ts))) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 900000 AS w FROM landed_v GROUP BY run),
judged_v AS (SELECT l.*, coalesce((epoch_us(ts) // {slot_us} + 1) * {slot_us} <= w * 1000, false) AS late FROM landed_v l JOIN mark_v USING (run))"""


def _through(spark, rows, schema, run, job, label):
    """Land `rows` run by run, take each up with the stream `job` makes of the folder, and return all it wrote."""
    o.use_rocksdb(spark)
    landed, out, state = (scratch_path(spark, f"{label}-{x}") for x in ("landed", "out", "state"))
    tick = rows.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts")).select(*[(F.col("ts") if c == "ts" else F.lit(TICK) if c == "site_id" else F.lit(None)).cast(t).alias(c) for c, t in rows.select([x.split()[0] for x in schema.split(", ")]).dtypes])
    placed = rows.withColumn("__run", run)
    for k in range(RUNS):
        part = placed.filter(F.col("__run") == k).select(tick.columns)
        (part if k < RUNS - 1 else part.unionByName(tick)).write.mode("append").parquet(landed)
        stream = job(j.read_readings(spark, landed, schema, max_files=1_000_000))
        _take_up(spark, stream, out, state, k == RUNS - 1)
    return spark.read.schema(stream.schema).parquet(out).filter(F.col("site_id") != TICK)


def _events(spark, sf, job, label, ts=None):
    rows = v.readings(spark, sf)
    run = _run_of(F.col("ts"), F.col("event_id") % 7 == 0)
    rows = rows.withColumn("__at", run)
    if ts is not None:
        rows = rows.withColumn("ts", ts)
    return _through(spark, rows, LANDED, F.col("__at"), job, label)


@query("stream_first_write", f"""{R}, {judged(300_000_000, ROUND5.replace("(ts)", "(r.ts)"))},
n AS (SELECT *, row_number() OVER (PARTITION BY site_id, name, ts ORDER BY late, CASE WHEN late THEN 0 ELSE run END, event_id) AS n FROM judged_v)
SELECT site_id, name, epoch_us(ts) AS ts_us, value FROM n WHERE n = 1""")
def stream_first_write(spark, sf):
    out = _events(spark, sf, lambda s: o.first_writes(s, F.col("event_id")), "first-write", round5(F.col("ts")))
    return o.merged_first_writes(out).select("site_id", "name", v.us("ts").alias("ts_us"), F.col("value").cast("double").alias("value"))


@query("stream_insert_ignore", R + f" SELECT site_id, name, epoch_us({ROUND5}) AS ts_us, arg_min(value, event_id) AS value FROM readings_v GROUP BY site_id, name, {ROUND5}")
def stream_insert_ignore(spark, sf):
    raw = j.read_readings(spark, f"{sf}/events.parquet", "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    keyed = raw.select((F.col("user_id") % 16).alias("site_id"), round5(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("name"), "value", "event_id")
    out, checkpoint = scratch_path(spark, "ignore"), scratch_path(spark, "ignore-state")
    j.append_new_batches(keyed, out, checkpoint, arrival=F.col("event_id")).awaitTermination()
    return spark.read.parquet(out).select("site_id", "name", v.us("ts").alias("ts_us"), "value")


@query("stream_rollup", R + f" SELECT site_id, name, epoch_us({ROUND5}) AS ts_us, count(*) AS n_rows, round(avg(value), 6) AS mean_value, min(value) AS min_value, max(value) AS max_value FROM readings_v GROUP BY site_id, name, {ROUND5}")
def stream_rollup(spark, sf):
    out = o.merged_rollup(_events(spark, sf, o.rollup, "rollup", round5(F.col("ts"))))
    return out.select("site_id", "name", v.us("ts").alias("ts_us"), "n_rows", v.r6("mean_value").alias("mean_value"), "min_value", "max_value")


@query("stream_late_rows", f"""{R}, {judged(300_000_000, ROUND5.replace("(ts)", "(r.ts)"))} SELECT site_id, name, epoch_us(ts) AS ts_us, count(*) FILTER (NOT late) AS n_closed, count(*) FILTER (late) AS n_late FROM judged_v GROUP BY 1, 2, 3""")
def stream_late_rows(spark, sf):
    """What the closed windows held, and the table of late rows beside them."""
    out = _events(spark, sf, o.rollup, "late", round5(F.col("ts")))
    n = lambda late: F.coalesce(F.sum(F.when(F.col("late") == late, F.col("n_rows"))), F.lit(0))
    return out.groupBy("site_id", "name", v.us("ts").alias("ts_us")).agg(n(False).alias("n_closed"), n(True).alias("n_late"))


@query("stream_change_only", f"""{R}, {judged(3_600_000_000)}, b AS (SELECT site_id, name, event_id, ts, late, CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS value FROM judged_v),
l AS (SELECT *, lag(value) OVER w AS prev, row_number() OVER w AS rn FROM b WHERE NOT late WINDOW w AS (PARTITION BY site_id, name ORDER BY ts, event_id))
SELECT site_id, name, epoch_us(ts) AS ts_us, value, late FROM l WHERE rn = 1 OR value IS DISTINCT FROM prev UNION ALL SELECT site_id, name, epoch_us(ts), value, late FROM b WHERE late""")
def stream_change_only(spark, sf):
    def job(s):
        level = F.floor(F.col("value") / 50).cast("string")
        return o.change_only(s.withColumn("value", level), slot=60 * o.MINUTE, tie=F.lpad(F.col("event_id").cast("string"), 19, "0"))

    return _events(spark, sf, job, "changes").select("site_id", "name", v.us("ts").alias("ts_us"), "value", "late")


@query("stream_cooldown", SQL["cooldown_scan"].replace(v.READINGS, f"{v.READINGS}, {judged(3_600_000_000)}, time_v AS (SELECT * FROM judged_v WHERE NOT late)").replace("FROM readings_v", "FROM time_v").replace("JOIN readings_v", "JOIN time_v")
    .replace("FROM time_v r)", "FROM readings_v r)").replace("landed_v AS (SELECT site_id, name, value, event_id, ts AS ts", "landed_v AS (SELECT site_id, name, value, event_id, ts AS ts")
    .replace("AS ts_us FROM s", "AS ts_us, false AS late FROM s UNION ALL SELECT site_id, name, epoch_us(ts), late FROM judged_v WHERE late"))
def stream_cooldown(spark, sf):
    job = lambda s: o.cooldown(s.withColumnRenamed("ts", "raised_at"), ["site_id", "name"], 6 * 3600, slot=60 * o.MINUTE)
    return _events(spark, sf, job, "cooldown").select("site_id", "name", v.us("raised_at").alias("ts_us"), "late")


@query("stream_heartbeat", f"""{R}, {judged(3_600_000_000)}, l AS (SELECT site_id, epoch_us(ts) AS us, row_number() OVER w AS n, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap, lag(epoch_us(ts)) OVER w AS prev FROM judged_v WHERE NOT late WINDOW w AS (PARTITION BY site_id ORDER BY ts, event_id))
SELECT site_id, 'alive' AS status, us AS last_us, n AS n_rows FROM l WHERE n = 1 OR gap > 7200000000 UNION ALL SELECT site_id, 'stale', prev, n - 1 FROM l WHERE gap > 7200000000
UNION ALL SELECT site_id, 'stale', max(us), max(n) FROM l GROUP BY 1 UNION ALL SELECT site_id, 'late', epoch_us(ts), 1 FROM judged_v WHERE late""")
def stream_heartbeat(spark, sf):
    """Sites that fell silent for two hours and came back; the tick at the end finds all of them silent."""
    out = _events(spark, sf, lambda s: o.heartbeat(s, silent_seconds=7200, slot=60 * o.MINUTE), "heartbeat")
    return out.select("site_id", "status", v.us("last_ts").alias("last_us"), "n_rows")


@query("stream_sessions", R + f""", l AS (SELECT *, lag(ts) OVER (PARTITION BY site_id ORDER BY ts) AS prev FROM readings_v), s AS (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(prev) >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY ts) AS sid FROM l)
SELECT site_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n_rows FROM s GROUP BY site_id, sid""")
def stream_sessions(spark, sf):
    out = _events(spark, sf, lambda s: o.sessions(s, ["site_id"], 7200, slot=60 * o.MINUTE), "sessions")
    out = o.merged_sessions(out, ["site_id"], 7200)
    return out.select("site_id", v.us("start_ts").alias("start_us"), v.us("end_ts").alias("end_us"), "n_rows")


def _predictions(rows):
    return rows.select("site_id", F.col("ts").alias("decision_ts"), F.col("name").alias("sensor"), F.lit("1h").alias("horizon"),
                       add_seconds(F.col("ts"), 3600).alias("wanted_ts"), F.col("value").alias("predicted"))


@query("stream_outcomes", R + """, p AS (SELECT site_id, name, ts AS dts, ts + INTERVAL 1 HOUR AS wanted, value FROM readings_v), c AS (SELECT p.*, r.value AS actual, row_number() OVER (PARTITION BY p.site_id, p.name, p.dts ORDER BY abs(epoch_us(r.ts) - epoch_us(p.wanted)), r.ts) AS n FROM p JOIN readings_v r ON r.site_id = p.site_id AND r.name = p.name AND abs(epoch_us(r.ts) - epoch_us(p.wanted)) <= 3600000000)
SELECT site_id, name AS sensor, epoch_us(dts) AS decision_us, actual, round(value - actual, 3) AS error FROM c WHERE n = 1""")
def stream_outcomes(spark, sf):
    """The stream picks and evicts; late predictions and late readings are matched again, nothing else. Only the tick gets a
    value; a reading without one takes no part."""
    out = _events(spark, sf, lambda s: o.outcomes(_predictions(s.filter(F.col("site_id") >= 0)), s.withColumn("value", F.when(F.col("site_id") == TICK, 0.0).otherwise(F.col("value"))), 3600, slot=60 * o.MINUTE), "outcomes")
    r = v.readings(spark, sf)
    found = o.merged_outcomes(out, _predictions(r), r, 3600)
    return found.select("site_id", "sensor", v.us("decision_ts").alias("decision_us"), "actual", "error")


@query("stream_state_ingest", f"""WITH {v.STATES}, n AS (SELECT name, unnest(CASE name WHEN 'purchase' THEN ['purchase_temp', 'purchase_target', 'purchase_action'] WHEN 'signup' THEN ['signup_mode'] ELSE [name] END) AS column_name FROM (SELECT DISTINCT name FROM states_v))
SELECT DISTINCT site_id, column_name AS name, epoch_us({ROUND5}) AS ts_us FROM states_v JOIN n USING (name)""")
def stream_state_ingest(spark, sf):
    """States land as JSON lines, run by run, and become readings on five-minute keys; late ones are merged."""
    o.use_rocksdb(spark)
    landed, out, state = (scratch_path(spark, f"ingest-{x}") for x in ("landed", "out", "state"))
    states = _entity_states(spark, sf)
    at = F.coalesce("last_updated", "last_changed")
    placed = states.withColumn("__run", _run_of(at, F.minute(at) % 7 == 0))
    for k in range(RUNS):
        placed.filter(F.col("__run") == k).drop("__run").write.mode("append").json(landed)
        readings = states_to_readings(j.read_states(spark, landed, max_files=1_000_000), _dims(spark, sf)).withColumn("ts", round5(F.col("ts")))
        stream = o.first_writes(readings, F.lit(k))
        _take_up(spark, stream, out, state, k == RUNS - 1)
    written = o.merged_first_writes(spark.read.schema(stream.schema).parquet(out))
    return written.select("site_id", "name", v.us("ts").alias("ts_us"))
