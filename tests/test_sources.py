import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import at, rows
from thermofleet import schemas
from thermofleet.operators import lookup as lk
from thermofleet.operators import reshape as rs
from thermofleet.sources import decisions as ds
from thermofleet.sources import dims, forecast, params, readings, runs, states


def test_states_to_readings_kinds(spark):
    now = at(0)
    s = spark.createDataFrame(
        [
            (1, "climate.up", "heat", {"current_temperature": "70.5", "temperature": "72", "hvac_action": "heating"}, now, now),
            (1, "fan.b", "on", {}, now, now),
            (1, "fan.c", "off", {"preset_mode": "high"}, now, now),
            (1, "sensor.t", "unavailable", {}, now, now),
            (1, "cover.s", "open", {"current_position": "30"}, now, now),
            (1, "weather.h", "sunny", {"temperature": "40", "humidity": "50", "wind_speed": "3"}, now, now),
        ],
        schemas.ENTITY_STATES,
    )
    d = spark.createDataFrame(
        [
            (1, "climate.up", "climate", "up", None, "manual", False), (1, "fan.b", "fan", "b", None, None, False), (1, "fan.c", "fan", "c", None, None, False),
            (1, "sensor.t", "numeric", "t", None, None, False), (1, "cover.s", "cover", "s", "closed", None, False), (1, "weather.h", "weather", "w", None, None, False),
        ],
        "site_id bigint, entity_id string, kind string, name string, active_state string, mode_control string, has_command boolean",
    )
    got = dict(rows(states.states_to_readings(s, d), "name", "value"))
    assert got["up_temp"] == "70.5" and got["up_action"] == "heating" and got["b_mode"] == "low" and got["c_mode"] == "off"
    assert got["t"] is None and got["s"] == "0.7" and got["met_outdoor_temp"] == "40" and got["weather_condition"] == "sunny"
    assert "cloud_coverage" not in got
    assert dict(rows(states.states_to_readings(s, d, zero_fill=True), "name", "value"))["t"] == "0.0"


def test_history_drops_gone_and_unparsable_times(spark):
    h = spark.createDataFrame(
        [(1, "a", "5.5", {}, "2026-01-01T00:00:00+00:00", ""), (1, "a", "x", {}, "", "2026-01-01T01:00:00Z"), (1, "a", "unknown", {}, "2026-01-01T02:00:00Z", ""), (1, "a", "1", {}, "soon", "")],
        schemas.STATE_HISTORY_JSON,
    )
    got = rows(states.history_to_series(h, "numeric").orderBy("ts"), "ts", "value")
    assert got == [(datetime(2026, 1, 1), 5.5), (datetime(2026, 1, 1, 1), None)]


def test_forecast_file(spark, tmp_path):
    body = {"service_response": {"weather.h": {"forecast": [
        {"datetime": "2026-01-01T01:00:00+00:00", "temperature": 40, "condition": "sunny", "wind_speed": 2.5},
        {"datetime": "2026-01-01T02:00:00+00:00", "temperature": 41.5}, {"datetime": "bad", "temperature": 1}]}}}
    (tmp_path / "f.json").write_text(json.dumps({"site_id": 1, "issued_at": "2026-01-01T00:00:00", "body": json.dumps(body)}))
    df = forecast.read_forecast(spark, str(tmp_path))
    assert rows(df, "temperature", "condition", "wind_speed") == [(40.0, "sunny", 2.5), (41.5, "unknown", None)]
    assert forecast.hourly_array(df).first().outdoor == [40.0, 41.5]


def test_insert_or_ignore_appends_only_new_keys(spark, tmp_path):
    path = str(tmp_path / "r")
    empty = spark.createDataFrame([], schemas.READINGS)
    first = spark.createDataFrame([(1, at(0), "a", "1", 1), (1, at(0), "a", "2", 2)], schemas.READINGS + ", arrival bigint")
    readings.append_new(empty, first, path)
    again = spark.createDataFrame([(1, at(0), "a", "9", 1), (1, at(5), "a", "3", 1)], schemas.READINGS + ", arrival bigint")
    readings.append_new(readings.read_readings(spark, path), again, path)
    assert rows(readings.read_readings(spark, path), "ts", "value") == [(at(0), "1"), (at(5), "3")]
    assert readings.read_readings(spark, path, since="2026-01-01 00:03:00").count() == 1


def test_range_filter_prunes_partitions_and_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame([(1, at(0), "a", "1"), (1, at(3_000), "a", "2")], schemas.READINGS).withColumn("dt", F.to_date("ts"))
    readings.write_table(df, path, ["dt"])
    plan = readings.read_readings(spark, path, since="2026-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "GreaterThanOrEqual(ts" in plan


def test_dynamic_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "o")
    base = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d2")], "k int, v string, dt string")
    readings.write_table(base, path, ["dt"])
    readings.replace_partitions(spark.createDataFrame([(1, "z", "d1")], "k int, v string, dt string"), path)
    assert rows(readings.read_table(spark, path).select("k", "v", F.col("dt").cast("string"))) == [(1, "z", "d1"), (2, "b", "d2")]


def test_upsert_tolerates_missing_columns(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 5)], "k int, v string, extra int")
    assert sorted(readings.upsert_by_key(base, new, ["k"]).collect(), key=lambda r: r.k) == [(1, "a", None), (2, "c", 5)]


def test_decisions_with_missing_columns_and_broken_text(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, at(0), '{"a": {"1h": 70.0}}', "{oops")], "site_id bigint, ts timestamp, predictions string, comfort_bounds string").write.parquet(path)
    row = ds.read_decisions(spark, path, limit=1).first()
    assert row.predictions == {"a": {"1h": 70.0}} and not row.comfort_bounds and row.blocked is None


def test_parameters_accept_older_names(spark, tmp_path):
    doc = {"fitted_taus": [{"sensor": "a", "tau_base": 45, "n_segments": 3, "window_betas": {"w": 0.01}}],
           "effector_sensor_gains": [{"effector": "e", "sensor": "a", "gain_f_per_hour": 3.0, "best_lag_minutes": 45.0, "t_statistic": 2.5, "negligible": False}],
           "solar_elevation_gains": {"a": 1.5}, "advisory_solar_betas": {"s": {"a": -0.5}}}
    (tmp_path / "fit1.json").write_text(json.dumps(doc, indent=1))
    docs = params.read_params(spark, str(tmp_path))
    assert rows(params.tau_betas(docs), "fit_id", "device", "beta") == [("fit1", "w", 0.01)]
    assert rows(params.solar_betas(docs), "device", "sensor", "beta") == [("s", "a", -0.5)]
    assert rows(params.taus(docs), "sensor", "tau_base") == [("a", 45.0)] and rows(params.solar_gains(docs), "gain") == [(1.5,)]
    effectors = spark.createDataFrame([(1, "e", ["heat"])], "site_id bigint, name string, supported_modes array<string>")
    assert rows(params.usable_gains(params.gains(docs).withColumn("site_id", F.lit(1)), effectors), "gain_f_per_hour") == [(2.0,)]


def test_run_documents_skip_malformed(spark, tmp_path):
    run = {"timestamp": "2026-01-01T00:00:00", "mode": "full", "experiment": None, "git_hash": "abcdefghij", "data": {"rows_raw": 5, "n_features": 2},
           "targets": [{"target": "bed_temp_t+12", "rmse": 1.0, "mae": 0.5, "n_train": 1, "n_val": 1}, {"target": "odd", "rmse": 3.0, "mae": 1.5, "n_train": 1, "n_val": 1}]}
    (tmp_path / "a.json").write_text(json.dumps(run))
    (tmp_path / "b.json").write_text("{not json")
    df = runs.read_runs(spark, str(tmp_path))
    assert rows(runs.run_targets(df), "room", "horizon", "rmse") == [("bed", "12h", 1.0), ("odd", "", 3.0)]
    assert rows(runs.run_history(df), "label", "git_hash", "mean_rmse") == [("full", "abcdefghij", 2.0)]
    assert runs.find_run(df, "a").count() == 1 and runs.find_run(df, "zz").count() == 0


def test_schedule_tiers_and_defaults(spark):
    table = dims.load_schedules(spark, 1, [{"sensor": "thermostat_up_temp", "schedule": [
        {"hours": [0, 24], "min": 66, "max": 72}, {"hours": [8, 9], "preferred": 70, "acceptable": [65, 75], "backup": [60, 80], "cold_penalty": 3}]}])
    got = rows(table, "label", "pref_lo", "pref_hi", "acc_lo", "backup_lo", "backup_hi", "cold_penalty", "hot_penalty")
    assert got == [("up", 69.0, 69.0, 66.0, 63.0, 75.0, 2.0, 1.0), ("up", 70.0, 70.0, 65.0, 60.0, 80.0, 3.0, 1.0)]


def test_schedule_first_entry_wins_and_wraps(spark):
    s = spark.createDataFrame([(1, "a", 0, 21, 6), (1, "a", 1, 0, 24), (1, "b", 0, 6, 9)], "site_id bigint, sensor string, seq int, start_hour int, end_hour int")
    got = {(r.sensor, r.hour): r.seq for r in lk.hourly_schedule(s).collect()}
    assert got[("a", 23)] == got[("a", 5)] == 0 and got[("a", 6)] == 1 and got[("b", 8)] == 0 and ("b", 9) not in got


def test_combinations_are_complete_and_start_with_first_options(spark):
    o = spark.createDataFrame([(1, c, i) for c, n in (("a", 3), ("b", 2), ("c", 4)) for i in range(n)], "site_id bigint, effector string, option_no bigint")
    plans = lk.combination_table(o, ["site_id"], "effector").groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("effector", "option_no"))).alias("c"))
    got = {r.plan_id: tuple(x.option_no for x in r.c) for r in plans.collect()}
    assert got[0] == (0, 0, 0) and len(got) == 24 == len(set(got.values()))


def test_long_and_wide_round_trip(spark):
    long = spark.createDataFrame([(1, at(0), "a", "1.5"), (1, at(0), "b", "x"), (1, at(5), "a", None)], schemas.READINGS)
    wide = rs.coerce(rs.to_wide(long, ["a", "b"]), {"a": "REAL", "b": "INTEGER"})
    assert rows(wide, "ts", "a", "b") == [(at(0), 1.5, None), (at(5), None, None)]
    assert rows(rs.to_long(wide), "ts", "name", "value") == [(at(0), "a", "1.5")]


def test_transpose_nested(spark):
    df = spark.createDataFrame([(1, {"s1": {"w": 0.1}, "s2": {"w": 0.2, "d": 0.3}})], "site_id bigint, m map<string,map<string,double>>")
    out = {r.device: r.m for r in rs.transpose_nested(df, "m", "sensor", "device", ["site_id"]).collect()}
    assert out == {"w": {"s1": 0.1, "s2": 0.2}, "d": {"s2": 0.3}}


def test_merged_reasons_let_the_physical_one_win(spark):
    df = spark.createDataFrame([({"a": "x", "b": "y"}, {"b": "z"}), (None, None)], "i map<string,string>, b map<string,string>")
    assert [r[0] for r in df.select(ds.merged_reasons(F.col("i"), F.col("b"))).collect()] == [{"a": "x", "b": "z"}, None]


def test_approximate_stats(spark):
    from thermofleet.operators.aggregates import table_stats

    df = spark.createDataFrame([(1, at(i % 10), f"n{i % 3}", "1") for i in range(60)], schemas.READINGS)
    exact, rough = table_stats(df).first(), table_stats(df, approximate=True).first()
    assert exact.n_timestamps == 10 and exact.n_names == 3 and exact.n_rows == rough.n_rows == 60
    assert rough.n_timestamps == pytest.approx(10, abs=1)


def test_upsert_rewrites_touched_days_once(spark, tmp_path):
    import os

    path = str(tmp_path / "t")
    schema = "site_id bigint, ts timestamp, v bigint, arrival bigint"
    first = spark.createDataFrame([(1, at(0), 1, 0), (1, at(1_500), 2, 0), (2, at(3_000), 3, 0), (2, at(3_000), 4, 1)], schema)
    assert readings.upsert_days(first, path, ["site_id", "ts"], 1, "arrival")
    kept = {f: os.path.getmtime(f"{path}/dt=2026-01-01/{f}") for f in os.listdir(f"{path}/dt=2026-01-01")}
    second = spark.createDataFrame([(1, at(1_500), 9, 0), (3, at(1_600), 5, 0), (3, at(9_000), 6, 0)], schema)
    assert readings.upsert_days(second, path, ["site_id", "ts"], 2, "arrival")
    assert not readings.upsert_days(second.withColumn("v", F.lit(0).cast("bigint")), path, ["site_id", "ts"], 2, "arrival")
    assert rows(spark.read.parquet(path), "site_id", "ts", "v") == [(1, at(0), 1), (1, at(1_500), 9), (2, at(3_000), 4), (3, at(1_600), 5), (3, at(9_000), 6)]
    assert kept == {f: os.path.getmtime(f"{path}/dt=2026-01-01/{f}") for f in os.listdir(f"{path}/dt=2026-01-01")}
