"""Documents and states landed as files: written from the tables to the shared folder, read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermofleet.harness import views as v
from thermofleet.harness.registry import query
from thermofleet.session import scratch_path
from thermofleet.sources import dims, params, runs

SITE_SQL = "'site' || (l_suppkey % 16)"
PART = f"WITH p AS (SELECT {SITE_SQL} || '_s' || (l_partkey % 8) AS sensor, 'e' || (l_partkey % 12) AS effector, 'd' || (l_partkey % 5) AS device, l_suppkey % 16 AS site_id, l_quantity, l_discount, l_linenumber FROM lineitem)"


def _one_file_each(df, spark, label):
    """Every row as a document of its own."""
    path = scratch_path(spark, label)
    df.write.option("maxRecordsPerFile", 1).json(path)
    return path


def _parameter_documents(spark, sf):
    l = v.table(spark, sf, "lineitem")
    part = l.select(
        F.concat(F.lit("site"), (F.col("l_suppkey") % 16).cast("string"), F.lit("_s"), (F.col("l_partkey") % 8).cast("string")).alias("sensor"),
        F.concat(F.lit("e"), (F.col("l_partkey") % 12).cast("string")).alias("effector"), F.concat(F.lit("d"), (F.col("l_partkey") % 5).cast("string")).alias("device"),
        (F.col("l_suppkey") % 16).alias("site_id"), "l_quantity", "l_discount", "l_linenumber")
    beta = part.groupBy("site_id", "sensor", "device").agg(F.max("l_discount").cast("double").alias("beta"))
    betas = beta.groupBy("site_id", "sensor").agg(F.map_from_entries(F.collect_list(F.struct("device", "beta"))).alias("environment_tau_betas"))
    tau = part.groupBy("site_id", "sensor").agg((F.max("l_quantity").cast("double") + 20).alias("tau_base"), F.count(F.lit(1)).cast("int").alias("n_segments")).join(betas, ["site_id", "sensor"])
    taus = tau.groupBy("site_id").agg(F.collect_list(F.struct("sensor", "tau_base", "n_segments", "environment_tau_betas")).alias("fitted_taus"))
    gain = part.groupBy("site_id", "effector", "sensor").agg((F.max("l_quantity").cast("double") / 10).alias("gain_f_per_hour"), F.max("l_linenumber").cast("double").alias("best_lag_minutes"))
    gains = gain.groupBy("site_id").agg(F.collect_list(F.struct("effector", "sensor", "gain_f_per_hour", "best_lag_minutes")).alias("effector_sensor_gains"))
    docs = taus.join(gains, "site_id").drop("site_id")
    return params.read_params(spark, _one_file_each(docs, spark, "parameters"))


@query("params_taus", PART + " SELECT sensor, CAST(max(l_quantity) AS DOUBLE) + 20 AS tau_base, CAST(count(*) AS INTEGER) AS n_segments FROM p GROUP BY 1")
def params_taus(spark, sf):
    return params.taus(_parameter_documents(spark, sf)).select("sensor", "tau_base", "n_segments")


@query("params_betas", PART + " SELECT sensor, device, CAST(max(l_discount) AS DOUBLE) AS beta, 'tau' AS kind FROM p GROUP BY 1, 2")
def params_betas(spark, sf):
    return params.tau_betas(_parameter_documents(spark, sf)).select("sensor", "device", "beta", "kind")


@query("params_gains", PART + " SELECT effector, sensor, CAST(max(l_quantity) AS DOUBLE) / 10 AS gain_f_per_hour, CAST(max(l_linenumber) AS DOUBLE) AS best_lag_minutes FROM p GROUP BY 1, 2")
def params_gains(spark, sf):
    return params.gains(_parameter_documents(spark, sf)).select("effector", "sensor", "gain_f_per_hour", "best_lag_minutes")


@query("run_files", """WITH t AS (SELECT o_custkey % 40 AS run, 'room' || (o_orderkey % 6) AS room, count(*) AS n, CAST(max(o_totalprice) AS DOUBLE) AS rmse, CAST(min(o_totalprice) AS DOUBLE) AS mae FROM orders GROUP BY 1, 2)
SELECT 'run' || run AS experiment, 'hash' || run || 'ofmorethansevenletters' AS git_hash, room, '1h' AS horizon, rmse, mae, n AS n_train FROM t""")
def run_files(spark, sf):
    t = v.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 40).alias("run"), F.concat(F.lit("room"), (F.col("o_orderkey") % 6).cast("string"), F.lit("_temp_t+1")).alias("target")).agg(
        F.count(F.lit(1)).alias("n_train"), F.max("o_totalprice").cast("double").alias("rmse"), F.min("o_totalprice").cast("double").alias("mae"))
    docs = t.groupBy("run").agg(F.collect_list(F.struct("target", "rmse", "mae", "n_train")).alias("targets")).select(
        F.lit("2026-01-01T00:00:00").alias("timestamp"), F.lit("full").alias("mode"), F.concat(F.lit("run"), F.col("run").cast("string")).alias("experiment"),
        F.concat(F.lit("hash"), F.col("run").cast("string"), F.lit("ofmorethansevenletters")).alias("git_hash"), "targets")
    found = runs.run_targets(runs.read_runs(spark, _one_file_each(docs, spark, "runs")))
    return found.select("experiment", "git_hash", "room", "horizon", "rmse", "mae", "n_train")


@query("schedule_tiers", """WITH r AS (SELECT p_partkey % 16 AS site_id, p_partkey, p_size % 24 AS h, 60.0 + p_size % 9 AS lo, 70.0 + p_size % 11 AS hi, p_size % 3 AS k FROM part)
SELECT site_id, p_partkey AS seq, h AS start_hour, CASE WHEN k = 0 THEN (lo + hi) / 2 ELSE lo + 1 END AS pref_lo, CASE WHEN k = 0 THEN (lo + hi) / 2 WHEN k = 1 THEN lo + 1 ELSE lo + 2 END AS pref_hi,
lo AS acc_lo, hi AS acc_hi, lo - 3 AS backup_lo, hi + 3 AS backup_hi FROM r""")
def schedule_tiers(spark, sf):
    k, size = F.col("p_size") % 3, F.col("p_size")
    lo, hi = (60 + size % 9).cast("double"), (70 + size % 11).cast("double")
    empty = F.lit(None).cast("array<double>")
    raw = v.table(spark, sf, "part").select(
        (F.col("p_partkey") % 16).alias("site_id"), F.lit("thermostat_a_temp").alias("sensor"), F.col("p_partkey").alias("seq"), (size % 24).alias("start_hour"), F.lit(24).alias("end_hour"),
        F.when(k == 1, F.array(lo + 1, lo + 1)).when(k == 2, F.array(lo + 1, lo + 2)).alias("preferred"), F.when(k == 2, F.array(lo, hi)).alias("acceptable"),
        lo.alias("min"), hi.alias("max"), empty.alias("backup"), *[F.lit(None).cast("double").alias(c) for c in ("cold_penalty", "hot_penalty", "weight")])
    out = dims.schedule_table(raw)
    return out.select("site_id", "seq", "start_hour", "pref_lo", "pref_hi", "acc_lo", "acc_hi", "backup_lo", "backup_hi")


EFFECTOR_DOCS = "e AS (SELECT p_partkey % 16 AS site_id, 'e' || p_partkey AS name, p_size, CASE p_size % 3 WHEN 0 THEN 0.0 WHEN 1 THEN p_size / 4.0 END AS plain FROM part)"


def _effectors(spark, sf):
    """Effector documents, landed and read back: cost absent, one number, or one per mode."""
    size = F.col("p_size")
    text = lambda x: x.cast("double").cast("string")
    raw = v.table(spark, sf, "part").select(
        (F.col("p_partkey") % 16).alias("site_id"), F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("name"), F.lit("trajectory").alias("control_type"),
        F.when(size % 2 == 0, F.lit("manual")).alias("mode_control"), F.when(size % 5 == 0, size + 60).alias("max_lag_minutes"), F.when(size % 4 == 0, F.array(size % 24, (size + 3) % 24)).alias("mode_hold_window"),
        F.when(size % 3 == 1, text(size / 4)).when(size % 3 == 2, F.to_json(F.create_map(F.lit("heat"), size / 2.0, F.lit("cool"), size.cast("double")))).alias("energy_cost"))
    path = scratch_path(spark, "effectors")
    raw.write.json(path)
    return dims.effector_table(spark.read.schema(dims.EFFECTORS_RAW).json(path))


@query("effector_costs", f"""WITH {EFFECTOR_DOCS}, c AS (SELECT *, unnest(CASE p_size % 3 WHEN 2 THEN ['heat', 'cool'] ELSE [''] END) AS mode FROM e)
SELECT site_id, name, CASE WHEN p_size % 2 = 0 THEN 'manual' ELSE 'automatic' END AS mode_control, CAST(CASE WHEN p_size % 5 = 0 THEN p_size + 60 ELSE 90 END AS INTEGER) AS max_lag_minutes,
CASE WHEN p_size % 4 = 0 THEN p_size % 24 END AS hold_start, mode, CASE mode WHEN 'heat' THEN p_size / 2.0 WHEN 'cool' THEN CAST(p_size AS DOUBLE) ELSE plain END AS cost FROM c""")
def effector_costs(spark, sf):
    return _effectors(spark, sf).select("site_id", "name", "mode_control", "max_lag_minutes", "hold_start", F.explode("energy_cost").alias("mode", "cost"))


@query("column_catalog", f"""WITH {EFFECTOR_DOCS} SELECT site_id, name || s.x AS column_name, CASE WHEN s.x IN ('_temp', '_target') THEN 'REAL' ELSE 'TEXT' END AS storage FROM e CROSS JOIN (VALUES ('_temp'), ('_target'), ('_mode'), ('_action')) s(x)
UNION SELECT user_id % 16, event_type, 'REAL' FROM events""")
def column_catalog(spark, sf):
    return dims.column_catalog(_effectors(spark, sf), v.readings(spark, sf).select("site_id", "name"))


@query("state_encodings", """SELECT 'p' || (p_size % 7) AS owner, p_type AS label, CAST(max(p_size) AS DOUBLE) AS code FROM part GROUP BY 1, 2""")
def state_encodings(spark, sf):
    part = v.table(spark, sf, "part")
    docs = part.select(F.concat(F.lit("p"), (F.col("p_size") % 7).cast("string")).alias("owner"), F.create_map("p_type", F.col("p_size").cast("double")).alias("labels"))
    return dims.encoding_table(docs)
