"""Views over the driver's tables, once as DataFrames and once as SQL text.

The driver's tables hold no sensor data, so readings, decisions, plans and gains are derived from `events` and
`lineitem` by the same rule on both sides. Rows grow with the tables; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermofleet.functions.timekeys import as_timestamp
from thermofleet.operators.grid import grid

HOUR = 3_600
NAMES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        (F.col("user_id") % 16).alias("site_id"), as_timestamp(F.col("ts")).alias("ts"), F.col("event_type").alias("name"),
        "value", "event_id",
    )


READINGS = "readings_v AS (SELECT user_id % 16 AS site_id, ts, event_type AS name, value, event_id FROM events)"


def states(spark: SparkSession, sf: str) -> DataFrame:
    """Readings with the number found in the JSON properties."""
    e = table(spark, sf, "events")
    return e.select(
        (F.col("user_id") % 16).alias("site_id"), as_timestamp(F.col("ts")).alias("ts"), F.col("event_type").alias("name"),
        "value", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


STATES = (
    "states_v AS (SELECT user_id % 16 AS site_id, ts, event_type AS name, value, event_id, "
    "CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
)


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Complete hourly grid per site, one column per name: the largest value of the hour or NULL."""
    r = readings(spark, sf)
    hour = F.date_trunc("hour", "ts")
    cells = r.groupBy("site_id", hour.alias("ts")).agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in NAMES]
    )
    return grid(r, ["site_id"], HOUR).join(cells, ["site_id", "ts"], "left")


HOURLY = (
    READINGS
    + ", span AS (SELECT site_id, date_trunc('hour', min(ts)) AS lo, max(ts) AS hi FROM readings_v GROUP BY site_id)"
    ", ticks AS (SELECT site_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span)"
    ", cells AS (SELECT site_id, date_trunc('hour', ts) AS ts, "
    + ", ".join(f"max(value) FILTER (WHERE name = '{n}') AS {n}" for n in NAMES)
    + " FROM readings_v GROUP BY 1, 2)"
    ", hourly_v AS (SELECT t.site_id, t.ts, " + ", ".join(f"c.{n}" for n in NAMES)
    + " FROM ticks t LEFT JOIN cells c ON c.site_id = t.site_id AND c.ts = t.ts)"
)


def filled(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly grid with every column held at its last value."""
    from thermofleet.operators.grid import forward_fill
    from thermofleet.operators.track import Track

    return forward_fill(hourly(spark, sf), Track(("site_id",)), NAMES)


FILLED = (
    HOURLY
    + ", filled_v AS (SELECT site_id, ts, "
    + ", ".join(f"last_value({n} IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY ts) AS {n}" for n in NAMES)
    + " FROM hourly_v)"
)


def sites(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).select("site_id").distinct()


SITES = "sites_v AS (SELECT DISTINCT user_id % 16 AS site_id FROM events)"

# (label, seq, start, end, pref_lo, pref_hi, acc_lo, acc_hi, cold, hot): the same three blocks for every name.
BLOCKS = [(0, 21, 6, 30.0, 55.0, 20.0, 80.0, 2.0, 1.0), (1, 6, 9, 40.0, 60.0, 30.0, 85.0, 3.0, 1.0),
          (2, 9, 21, 35.0, 50.0, 25.0, 75.0, 2.0, 1.5)]


def _structs(names: list[str], rows: list[tuple]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


SCHEDULE_NAMES = ["seq", "start_hour", "end_hour", "pref_lo", "pref_hi", "acc_lo", "acc_hi", "cold_penalty", "hot_penalty"]


def schedules(spark: SparkSession, sf: str, sensors: list[str] = NAMES) -> DataFrame:
    rows = (
        sites(spark, sf)
        .withColumn("sensor", F.explode(F.array(*[F.lit(s) for s in sensors])))
        .withColumn("b", F.explode(_structs(SCHEDULE_NAMES, BLOCKS)))
    )
    return rows.select("site_id", "sensor", F.col("sensor").alias("label"), "b.*").withColumns(
        {"backup_lo": F.col("acc_lo") - 3.0, "backup_hi": F.col("acc_hi") + 3.0, "weight": F.lit(1.0)}
    )


def values_sql(rows: list[tuple]) -> str:
    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, str):
            return "'" + v + "'"
        return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


def schedules_sql(sensors: list[str] = NAMES) -> str:
    return (
        SITES
        + ", schedule_v AS (SELECT s.site_id, n.sensor, n.sensor AS label, b.*, b.acc_lo - 3.0 AS backup_lo, b.acc_hi + 3.0 AS backup_hi "
        f"FROM sites_v s CROSS JOIN (VALUES {values_sql([(x,) for x in sensors])}) n(sensor) "
        f"CROSS JOIN (VALUES {values_sql(BLOCKS)}) b({', '.join(SCHEDULE_NAMES)}))"
        ", hours_v AS (SELECT h.hour, s.* FROM schedule_v s JOIN (SELECT unnest(range(24)) AS hour) h "
        "ON CASE WHEN s.start_hour <= s.end_hour THEN h.hour >= s.start_hour AND h.hour < s.end_hour "
        "ELSE h.hour >= s.start_hour OR h.hour < s.end_hour END "
        "QUALIFY row_number() OVER (PARTITION BY s.site_id, s.sensor, h.hour ORDER BY s.seq) = 1)"
    )


def gains(spark: SparkSession, sf: str) -> DataFrame:
    """Gain rows per site, effector and sensor out of `lineitem`."""
    l = table(spark, sf, "lineitem")
    cells = l.groupBy(
        (F.col("l_suppkey") % 16).alias("site_id"),
        F.concat(F.lit("e"), (F.col("l_partkey") % 12).cast("string")).alias("effector"),
        F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("sensor"),
    ).agg(F.sum("l_quantity").cast("bigint").alias("q"), F.count(F.lit(1)).alias("n"))
    gain = (F.col("q") % 401 - 200) / 100.0
    t = (F.col("q") % 97 - 48) / 10.0
    return cells.select(
        "site_id", "effector", "sensor", gain.alias("gain_f_per_hour"), ((F.col("n") % 6) * 15.0).alias("best_lag_minutes"),
        t.alias("t_statistic"), ((F.abs(gain) < 0.3) & (F.abs(t) < 2.0)).alias("negligible"),
    )


GAINS = (
    "gain_cells AS (SELECT l_suppkey % 16 AS site_id, 'e' || (l_partkey % 12) AS effector, 's' || l_linenumber AS sensor, "
    "CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)"
    ", gains_v AS (SELECT site_id, effector, sensor, (q % 401 - 200) / CAST(100.0 AS DOUBLE) AS gain_f_per_hour, "
    "(n % 6) * CAST(15.0 AS DOUBLE) AS best_lag_minutes, (q % 97 - 48) / CAST(10.0 AS DOUBLE) AS t_statistic, "
    "abs((q % 401 - 200) / CAST(100.0 AS DOUBLE)) < 0.3 AND abs((q % 97 - 48) / CAST(10.0 AS DOUBLE)) < 2.0 AS negligible FROM gain_cells)"
)

# (name, control_type, band, sensor of the room it stands in, flat cost, low cost, high cost)
EFFECTORS = [
    ("e0", "trajectory", 1.0, "s1", 0.4, None, None), ("e1", "trajectory", 1.0, "s2", 0.5, None, None),
    ("e2", "trajectory", 1.0, "s3", 0.3, None, None), ("e3", "trajectory", 1.0, "s4", 0.6, None, None),
    ("e4", "regulating", 2.0, "s1", 0.2, None, None), ("e5", "regulating", 1.5, "s2", 0.25, None, None),
    ("e6", "regulating", 1.0, "s5", 0.3, None, None), ("e7", "regulating", 2.5, "s6", 0.35, None, None),
    ("e8", "binary", 1.0, None, None, 0.05, 0.1), ("e9", "binary", 1.0, None, None, 0.06, 0.12),
    ("e10", "binary", 1.0, None, None, 0.07, 0.14), ("e11", "binary", 1.0, None, None, 0.08, 0.16),
]
GAIN_SENSORS = [f"s{i}" for i in range(1, 8)]
# Fixed sites of the lineitem-derived views.
SUPPLY_SITES = "supply_sites AS (SELECT DISTINCT l_suppkey % 16 AS site_id FROM lineitem)"


def supply_sites(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select((F.col("l_suppkey") % 16).alias("site_id")).distinct()


def effectors(spark: SparkSession, sf: str) -> DataFrame:
    def cost(flat, low, high):
        pairs = [("", flat)] if flat is not None else [("low", low), ("high", high)]
        return F.create_map(*[F.lit(x) for p in pairs for x in p])

    modes = {"trajectory": ["off", "heating"], "regulating": ["heat", "cool"], "binary": ["off", "low", "high"]}
    items = [
        F.struct(
            F.lit(n).alias("name"), F.lit(c).alias("control_type"), F.lit(b).alias("proportional_band"),
            F.lit(s).cast("string").alias("temp_sensor"), cost(f, lo, hi).alias("energy_cost"),
            F.array(*[F.lit(m) for m in modes[c]]).alias("supported_modes"),
            F.array().cast("array<string>").alias("depends_on"),
            F.lit("manual" if c == "trajectory" else "automatic").alias("mode_control"),
            F.lit(22 if n in ("e4", "e5") else None).cast("int").alias("hold_start"),
            F.lit(7 if n in ("e4", "e5") else None).cast("int").alias("hold_end"),
        )
        for n, c, b, s, f, lo, hi in EFFECTORS
    ]
    return supply_sites(spark, sf).withColumn("e", F.explode(F.array(*items))).select("site_id", "e.*")


EFFECTORS_SQL = (
    SUPPLY_SITES
    + f", effectors_v AS (SELECT s.site_id, e.* FROM supply_sites s CROSS JOIN (VALUES {values_sql(EFFECTORS)}) "
    "e(name, control_type, proportional_band, temp_sensor, flat_cost, low_cost, high_cost))"
)

STEPS = {1: 12, 2: 24, 3: 48, 4: 72, 5: 12, 6: 24, 7: 48}


def plan_predictions(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    step = F.element_at(F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv]), F.col("l_linenumber"))
    return l.groupBy(
        (F.col("l_partkey") % 16).alias("site_id"), F.floor(F.col("l_partkey") / 16).alias("plan_id"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 8).cast("string")).alias("sensor"), step.alias("step"),
    ).agg((F.max("l_quantity") * 0.9 + 15.0).alias("temp"))


PLAN_PREDICTIONS = (
    "plan_predictions_v AS (SELECT l_partkey % 16 AS site_id, l_partkey // 16 AS plan_id, 's' || (l_suppkey % 8) AS sensor, "
    "CASE l_linenumber WHEN 1 THEN 12 WHEN 2 THEN 24 WHEN 3 THEN 48 WHEN 4 THEN 72 WHEN 5 THEN 12 WHEN 6 THEN 24 ELSE 48 END AS step, "
    "max(l_quantity) * CAST(0.9 AS DOUBLE) + 15.0 AS temp FROM lineitem GROUP BY 1, 2, 3, 4)"
)
PLAN_SENSORS = [f"s{i}" for i in range(8)]


def plan_schedules(spark: SparkSession, sf: str) -> DataFrame:
    return schedules(spark, sf, PLAN_SENSORS)


def plan_options(spark: SparkSession, sf: str) -> DataFrame:
    """One option per plan and effector."""
    l = table(spark, sf, "lineitem")
    i = F.col("l_suppkey") % 12
    rows = l.groupBy(
        (F.col("l_partkey") % 16).alias("site_id"), F.floor(F.col("l_partkey") / 16).alias("plan_id"), i.alias("i")
    ).agg(F.max("l_linenumber").alias("ln"), F.max("l_quantity").alias("q"))
    third = F.col("ln") % 3
    mode = (
        F.when(third == 0, "off")
        .when(F.col("i") < 4, "heating")
        .when(F.col("i") < 8, F.when(third == 1, "heat").otherwise("cool"))
        .otherwise(F.when(third == 1, "low").otherwise("high"))
    )
    return rows.select(
        "site_id", "plan_id", F.concat(F.lit("e"), F.col("i").cast("string")).alias("effector"), mode.alias("mode"),
        F.when((F.col("i") >= 4) & (F.col("i") < 8) & (third != 0), F.col("q") + 40.0).alias("target"),
        (third * 12).alias("delay_steps"), F.when(F.col("ln") % 4 != 0, F.col("ln") * 6).alias("duration_steps"),
        F.col("ln").cast("bigint").alias("option_no"),
    )


PLAN_OPTIONS = (
    "po AS (SELECT l_partkey % 16 AS site_id, l_partkey // 16 AS plan_id, l_suppkey % 12 AS i, max(l_linenumber) AS ln, max(l_quantity) AS q "
    "FROM lineitem GROUP BY 1, 2, 3), plan_options_v AS (SELECT site_id, plan_id, 'e' || i AS effector, "
    "CASE WHEN ln % 3 = 0 THEN 'off' WHEN i < 4 THEN 'heating' WHEN i < 8 THEN CASE WHEN ln % 3 = 1 THEN 'heat' ELSE 'cool' END "
    "ELSE CASE WHEN ln % 3 = 1 THEN 'low' ELSE 'high' END END AS mode, "
    "CASE WHEN i >= 4 AND i < 8 AND ln % 3 <> 0 THEN q + 40.0 END AS target, ln % 3 * 12 AS delay_steps, "
    "CASE WHEN ln % 4 <> 0 THEN ln * 6 END AS duration_steps, CAST(ln AS BIGINT) AS option_no FROM po)"
)


def current(spark: SparkSession, sf: str) -> DataFrame:
    """Temperature now per site and sensor s1..s7."""
    l = table(spark, sf, "lineitem")
    cells = l.groupBy((F.col("l_suppkey") % 16).alias("site_id"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("sensor"))
    return cells.agg((F.sum("l_quantity").cast("bigint") % 40 + 45.0).alias("temp"))


CURRENT = (
    "current_v AS (SELECT l_suppkey % 16 AS site_id, 's' || l_linenumber AS sensor, CAST(sum(l_quantity) AS BIGINT) % 40 + CAST(45.0 AS DOUBLE) AS temp "
    "FROM lineitem GROUP BY 1, 2)"
)


def bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds in force now per site and sensor s1..s7."""
    l = table(spark, sf, "lineitem")
    cells = l.groupBy((F.col("l_suppkey") % 16).alias("site_id"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("sensor"))
    q = cells.agg(F.sum("l_quantity").cast("bigint").alias("q"))
    return q.select(
        "site_id", "sensor", (F.col("q") % 30 / 10.0 + 60.0).alias("pref_lo"), (F.col("q") % 37 / 10.0 + 66.0).alias("pref_hi"),
        (F.col("q") % 9 + 54.0).alias("acc_lo"), (F.col("q") % 7 + 72.0).alias("acc_hi"),
    )


BOUNDS = (
    "bounds_q AS (SELECT l_suppkey % 16 AS site_id, 's' || l_linenumber AS sensor, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2), "
    "bounds_v AS (SELECT site_id, sensor, q % 30 / CAST(10.0 AS DOUBLE) + 60.0 AS pref_lo, q % 37 / CAST(10.0 AS DOUBLE) + 66.0 AS pref_hi, "
    "q % 9 + CAST(54.0 AS DOUBLE) AS acc_lo, q % 7 + CAST(72.0 AS DOUBLE) AS acc_hi FROM bounds_q)"
)


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Run metrics out of `orders`: mode = priority, experiment = status, one run per month, target = quarter."""
    o = table(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.groupBy(
        F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("experiment"),
        F.date_format("o_orderdate", "yyyy-MM").alias("timestamp"),
        F.concat(F.lit("room"), (F.col("o_custkey") % 4).cast("string"), F.lit("_temp_t+"), ((F.col("o_custkey") % 3 + 1) * 12).cast("string")).alias("target"),
    ).agg(
        (F.sum(cents) % 1000 / 1000.0).alias("rmse"), (F.max(cents) % 700 / 1000.0).alias("mae"), F.count(F.lit(1)).alias("n_val")
    )


RUNS = (
    "runs_v AS (SELECT o_orderpriority AS mode, o_orderstatus AS experiment, strftime(o_orderdate, '%Y-%m') AS timestamp, "
    "'room' || (o_custkey % 4) || '_temp_t+' || ((o_custkey % 3 + 1) * 12) AS target, "
    "CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) % 1000 AS DOUBLE) / 1000.0 AS rmse, "
    "CAST(max(CAST(round(o_totalprice * 100) AS BIGINT)) % 700 AS DOUBLE) / 1000.0 AS mae, count(*) AS n_val "
    "FROM orders GROUP BY 1, 2, 3, 4)"
)


def us(column: str | Column) -> Column:
    """Timestamps leave the queries as epoch microseconds, so both engines hash the same number."""
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)


def r6(column: str | Column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)
