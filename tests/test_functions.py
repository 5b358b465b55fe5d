import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from thermofleet.functions import bands, labels, thermal, timekeys, units, weather


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("minute", "second", "expected"),
    [(2, 59, (10, 0)), (3, 0, (10, 5)), (57, 59, (10, 55)), (58, 0, (11, 0)), (0, 0, (10, 0)), (32, 30, (10, 30))],
)
def test_round5(spark, minute, second, expected):
    got = one(spark, timekeys.round5(F.lit(datetime(2026, 1, 1, 10, minute, second)).cast("timestamp")))
    assert (got.hour, got.minute, got.second) == (*expected, 0)


def test_round5_rolls_into_the_next_day(spark):
    got = one(spark, timekeys.round5(F.lit(datetime(2026, 1, 1, 23, 59)).cast("timestamp")))
    assert got == datetime(2026, 1, 2)


@pytest.mark.parametrize(("hour", "inside"), [(21, True), (23, True), (0, True), (5, True), (6, False), (20, False)])
def test_window_wraps_midnight(spark, hour, inside):
    assert one(spark, timekeys.hour_in_window(F.lit(hour), 21, 6)) is inside


def fold(current, outdoor, tau, hours):
    return thermal.newton_fold(
        F.lit(float(current)), F.array(*[F.lit(float(o)) for o in outdoor]).cast("array<double>"), F.lit(float(tau)), F.lit(float(hours))
    )


def test_newton_fold_matches_closed_form(spark):
    assert one(spark, fold(72, [40] * 12, 24, 6)) == pytest.approx(40 + 32 * math.exp(-6 / 24), abs=1e-9)


def test_newton_fold_edges(spark):
    assert one(spark, fold(72, [40], 24, 0)) == 72
    assert one(spark, fold(72, [], 24, 3)) == 72
    assert one(spark, fold(72, [40, 40], 24, 1.5)) == pytest.approx(40 + 32 * math.exp(-1.5 / 24))
    assert one(spark, fold(72, [40], 24, 5)) == pytest.approx(40 + 32 * math.exp(-5 / 24))
    assert one(spark, fold(60, [90], 24, 4)) > 60


def test_outdoor_at_lead_time(spark):
    fc = F.array(F.lit(50.0), F.lit(52.0))
    got = [one(spark, thermal.outdoor_at(F.lit(40.0), fc, F.lit(h))) for h in (0.0, 0.5, 1.0, 2.4, 9.0)]
    assert got == [40.0, 45.0, 50.0, 52.0, 52.0]


def test_effective_tau_floor(spark):
    assert one(spark, thermal.effective_tau(F.lit(45.0), F.lit(0.02))) == pytest.approx(1 / (1 / 45 + 0.02))
    assert one(spark, thermal.effective_tau(F.lit(500.0), F.lit(None).cast("double"))) == pytest.approx(100.0)


def test_solar_elevation_noon_and_night(spark):
    lat, lon = F.lit(47.6), F.lit(-122.3)
    noon = one(spark, weather.solar_elevation(lat, lon, F.lit(datetime(2026, 6, 21, 20, 9)).cast("timestamp")))
    night = one(spark, weather.solar_elevation(lat, lon, F.lit(datetime(2026, 6, 21, 8, 9)).cast("timestamp")))
    assert noon == pytest.approx(65.8, abs=1.0)
    assert night < 0
    assert one(spark, weather.positive_sine(F.lit(night))) == 0.0


def test_condition_tables(spark):
    assert one(spark, weather.solar_fraction(F.lit("sunny"))) == 1.0
    assert one(spark, weather.solar_fraction(F.lit("new"))) == 0.3
    assert one(spark, weather.condition_code(F.lit("new"))) == one(spark, weather.condition_code(F.lit("unknown"))) == 15


def test_units(spark):
    assert one(spark, units.abs_temp(F.lit(212.0), F.lit("C"))) == 100.0
    assert one(spark, units.delta_temp(F.lit(9.0), F.lit("C"))) == pytest.approx(5.0)
    assert one(spark, units.delta_temp(F.lit(9.0), F.lit("F"))) == 9.0


def test_names(spark):
    df = spark.createDataFrame(
        [("sensor.bed_air_temperature", "binary_sensor.window_kitchen_window_door_is_open", "thermostat_up_temp", "bedroom_temp_t+12")],
        "t string, w string, s string, target string",
    )
    room, horizon = labels.parse_target(F.col("target"))
    got = df.select(labels.temperature_name(F.col("t")), labels.opening_name(F.col("w")), labels.sensor_label(F.col("s")), room, horizon).first()
    # of the listed suffixes the first that fits is cut, and that is `_is_open`
    assert tuple(got) == ("bed_temp", "kitchen_window_door", "up", "bedroom", "12h")


def test_band_status_edges(spark):
    df = spark.createDataFrame([(60.0,), (59.9,), (80.1,), (64.0,), (71.0,), (68.0,), (None,)], "t double")
    got = [r[0] for r in df.select(bands.band_status(F.col("t"), F.lit(60.0), F.lit(80.0), F.lit(65.0), F.lit(70.0))).collect()]
    assert got == ["below pref", "COLD", "HOT", "below pref", "above pref", "in band", ""]


def test_two_rail_cost(spark):
    df = spark.createDataFrame([(68.0,), (65.0,), (58.0,), (75.0,), (81.0,)], "t double")
    cost = bands.two_rail_cost(F.col("t"), F.lit(67.0), F.lit(70.0), F.lit(60.0), F.lit(78.0), F.lit(2.0), F.lit(1.0), F.lit(0.5))
    got = [r[0] for r in df.select(cost).collect()]
    assert got == [0.0, 4.0, 81.0 + 4 * 3.0, 12.5, (121 + 27) * 0.5]


def test_lag_midpoint(spark):
    df = spark.createDataFrame([("0_15",), ("60_90",), ("x",), ("1_2_3",)], "l string")
    assert rows(df.select(labels.lag_midpoint(F.col("l")).alias("m"))) == [(0.0,), (0.0,), (7.5,), (75.0,)]
