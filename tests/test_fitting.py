import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import at, rows
from thermofleet.fitting import gains as g
from thermofleet.fitting import ridge as r
from thermofleet.fitting.gram import gram
from thermofleet.fitting.pipeline import fit_sites
from thermofleet.fitting.prepare import Effector, Layout, design, prepare, sensor_rows
from thermofleet.fitting.tau import fit_segments, sealed_and_ventilated, sensor_taus
from thermofleet.operators.spans import state_spans
from thermofleet.operators.track import Track

FEATURES = ["lag_a_0_15", "lag_a_15_30", "solar_elev", "adv_tau_w", "adv_tau_unused"]
KEYS = ["site_id", "sensor"]


@pytest.fixture(scope="module")
def sample(spark):
    rnd = np.random.RandomState(3)
    n = 1_500
    x = np.column_stack([rnd.rand(n), rnd.rand(n), 5 * rnd.rand(n), 20 * rnd.randn(n), np.zeros(n)])
    y = x @ np.array([1.0, -0.5, 0.3, 0.01, 0.0]) + 0.2 * rnd.randn(n)
    pdf = pd.DataFrame({"site_id": 1, "sensor": "s", "ts": [at(5 * i) for i in range(n)], "x": [list(map(float, v)) for v in x], "y": y})
    df = spark.createDataFrame(pdf, "site_id bigint, sensor string, ts timestamp, x array<double>, y double").repartition(5).cache()
    return x, y, df


def reference_ridge(x, y):
    scale = np.array([1, 1, x[:, 2].std(), x[:, 3].std()])
    z = x[:, :4] / scale
    lam = 0.01 * len(y)
    m = z.T @ z + lam * np.eye(4)
    beta = np.linalg.solve(m, z.T @ y) / scale
    s2 = np.sum((y - x[:, :4] @ beta) ** 2) / (len(y) - 4)
    return beta, beta / (np.sqrt(np.diag(s2 * np.linalg.inv(m))) / scale), scale, lam, z


def test_gram_is_the_cross_product(sample):
    x, y, df = sample
    z = np.column_stack([x, np.ones(len(y)), y])
    assert np.array(gram(df, KEYS).first().g) == pytest.approx((z.T @ z).ravel())


def test_ridge_equals_direct_solution(sample):
    x, y, df = sample
    got = r.ridge(df, FEATURES).first()
    beta, t, scale, lam, z = reference_ridge(x, y)
    assert got.n == 1_500 and got.n_features == 4 and got.lam == pytest.approx(lam)
    assert got.beta[:4] == pytest.approx(beta) and got.beta[4] == 0.0
    assert got.t[:4] == pytest.approx(t)
    resid = y - x[:, :4] @ beta
    assert got.r_squared == pytest.approx(1 - (resid**2).sum() / ((y - y.mean()) ** 2).sum())
    assert got.cond == pytest.approx(np.linalg.cond(z), rel=1e-6)
    assert all(v < 6 for v in got.vif)


def test_ridge_needs_enough_rows(sample):
    assert r.ridge(sample[2].limit(400), FEATURES).count() == 0


def test_collinear_columns_raise_vif_and_the_penalty(spark):
    rnd = np.random.RandomState(1)
    a = rnd.randn(800)
    x = np.column_stack([a, a * 1.0, rnd.randn(800)])
    pdf = pd.DataFrame({"site_id": 1, "sensor": "s", "x": [list(map(float, v)) for v in x], "y": a})
    got = r.ridge(spark.createDataFrame(pdf, "site_id bigint, sensor string, x array<double>, y double"), ["adv_a", "adv_b", "lag_c"]).first()
    assert got.vif[0] > 100 and got.vif[2] < 2
    assert got.lam == pytest.approx(0.1 * 800)


def test_holdout_and_bootstrap(sample):
    x, y, df = sample
    fits = r.ridge(df, FEATURES)
    held = r.holdout(df, fits).first()
    assert held.in_rmse == pytest.approx(0.2, abs=0.02) and abs(held.degradation) < 0.2
    first = dict(rows(r.bootstrap_cv(df, fits, FEATURES, replicates=20), "feature", "cv"))
    assert first["lag_a_0_15"] < 0.2 and first["adv_tau_unused"] == 0.0
    again = dict(rows(r.bootstrap_cv(df.repartition(3), fits, FEATURES, replicates=20), "feature", "cv"))
    assert again == pytest.approx(first)
    assert r.holdout(df, fits, min_rows=5_000).count() == 0


def test_residuals_match(sample):
    x, y, df = sample
    fits = r.ridge(df, FEATURES)
    beta = np.array(fits.first().beta)
    got = [v.residual for v in r.with_residuals(df, fits).orderBy("ts").collect()]
    assert got == pytest.approx(list(y - x @ beta))


def cooling(tau, n=24, start=70.0, outdoor=40.0, step=5):
    return [outdoor + (start - outdoor) * math.exp(-(i * step / 60) / tau) for i in range(n)]


@pytest.mark.parametrize("tau", [3.0, 24.0, 45.0, 180.0])
def test_tau_of_a_clean_decay(spark, tau):
    data = [(1, "s", 0, at(5 * i), t, 40.0) for i, t in enumerate(cooling(tau))]
    df = spark.createDataFrame(data, "site_id bigint, sensor string, segment_id bigint, ts timestamp, temp double, outdoor_best double")
    got = fit_segments(df, ["site_id", "sensor", "segment_id"]).first()
    assert got.tau == pytest.approx(tau, rel=0.01) and got.n_rows == 24


def test_segments_near_outdoors_are_left_out_and_defaults_apply(spark):
    data = [(1, "s", 0, at(5 * i), 40.5, 40.0) for i in range(20)]
    df = spark.createDataFrame(data, "site_id bigint, sensor string, segment_id bigint, ts timestamp, temp double, outdoor_best double")
    fits = fit_segments(df, ["site_id", "sensor", "segment_id"])
    assert fits.count() == 0
    sensors = spark.createDataFrame([(1, "s", 45.0)], "site_id bigint, sensor string, default_tau double")
    assert rows(sensor_taus(fits, sensors)) == [(1, "s", 45.0, 0)]


def test_sealed_and_ventilated(spark):
    temps = cooling(40.0, 30) + cooling(10.0, 30, start=60.0)
    data = [(1, "s", at(5 * i), t, 40.0, i >= 30) for i, t in enumerate(temps)]
    df = spark.createDataFrame(data, "site_id bigint, sensor string, ts timestamp, temp double, outdoor_best double, state boolean")
    spans = state_spans(df, Track(("site_id", "sensor")), "state")
    tagged = df.withColumn("run_no", F.when(F.col("state"), 2).otherwise(1).cast("bigint"))
    got = sealed_and_ventilated(tagged, spans).first()
    assert got.sealed == pytest.approx(40.0, rel=0.01) and got.ventilated == pytest.approx(10.0, rel=0.02) and not got.estimated
    closed = sealed_and_ventilated(tagged.filter("run_no = 1"), spans).first()
    assert closed.ventilated == pytest.approx(40.0 * 0.44, rel=0.01) and closed.estimated


def test_end_to_end_fit_recovers_a_heater(spark):
    """A room with tau 20 h and a heater of 3 degrees per hour, on the five-minute grid."""
    n = 3_000
    rnd = np.random.RandomState(0)
    temp, on, out = [65.0], [], []
    for i in range(n):
        on.append(1.0 if (i // 60) % 3 == 1 else 0.0)
        out.append(40.0 + 8 * math.sin(i / 130))
        temp.append(temp[-1] + (3.0 * on[-1] + (out[-1] - temp[-1]) / 20.0) / 12)
    data = [(1, at(5 * i), temp[i] + 0.02 * rnd.randn(), out[i], "heating" if on[i] else "idle") for i in range(n)]
    wide = spark.createDataFrame(data, "site_id bigint, ts timestamp, bed double, met_outdoor_temp double, heat_action string")
    layout = Layout(sensors=["bed"], effectors=[Effector("heat", "heat_action", {"heating": 1.0}, 15)])
    fit = fit_sites(wide, layout, replicates=10)
    tau = fit.taus.first()
    assert tau.tau_base == pytest.approx(20.0, rel=0.25) and tau.n_segments >= 5
    gain = fit.gains.first()
    assert gain.gain_f_per_hour == pytest.approx(3.0, rel=0.35) and not gain.negligible
    health = fit.health.first()
    assert health.grade in "AB" and health.r_squared > 0.3


def test_design_leaves_out_unsupported_environment(spark):
    data = [(1, at(5 * i), 65.0, 40.0, 1.0 if i < 10 else 0.0) for i in range(150)]
    wide = spark.createDataFrame(data, "site_id bigint, ts timestamp, bed double, met_outdoor_temp double, win double")
    layout = Layout(sensors=["bed"], environment={"win": "window"})
    prepared = sensor_rows(prepare(wide, layout), layout)
    taus = spark.createDataFrame([(1, "bed", 45.0)], "site_id bigint, sensor string, tau_base double")
    matrix, names = design(prepared, taus, layout)
    k = names.index("adv_tau_win")
    assert matrix.filter(F.element_at("x", k + 1) != 0).count() == 0
    assert matrix.count() == 144
    assert design(prepared, taus, layout, min_active=5)[0].filter(F.element_at("x", k + 1) != 0).count() == 7


@pytest.mark.parametrize(
    ("values", "grade"),
    [((0.12, 0.3, 8, 3, 0, 0.1, False), "A"), ((0.12, 0.3, 8, 3, 1, 0.1, False), "B"), ((0.05, 0.15, 3, 1, 0, None, False), "B"), ((0.05, 0.15, 2, 1, 0, None, False), "C"),
     ((0.12, 0.3, 0, 3, 0, None, False), "F"), ((0.12, 0.3, 8, 0, 0, None, False), "F"), ((0.01, 0.3, 8, 3, 0, None, False), "F"), ((0.12, 0.3, 8, 3, 0, 0.5, False), "C"), ((0.12, 0.3, 8, 3, 0, None, True), "F")],
)
def test_grades(spark, values, grade):
    df = spark.createDataFrame([values], "r_squared double, durbin_watson double, n_segments int, n_gains int, n_unstable_kept int, holdout_degradation double, has_errors boolean")
    assert g.health_grade(df).first().grade == grade


def test_issues_follow_the_bounds(spark):
    taus = spark.createDataFrame([(1, "a", 45.0)], "site_id bigint, sensor string, tau_base double")
    betas = spark.createDataFrame([(1, "a", "w", "tau", 0.5), (1, "a", "v", "tau", 0.02), (1, "a", "s", "solar", 2.5), (1, "a", "t", "solar", 1.0)], "site_id bigint, sensor string, device string, kind string, beta double")
    solar = spark.createDataFrame([(1, "a", 1.0)], "site_id bigint, sensor string, gain double")
    gains = spark.createDataFrame([(1, True)], "site_id bigint, negligible boolean")
    assert rows(g.result_issues(taus, betas, solar, gains), "check", "device", "severity") == [("env_solar_beta_magnitude", "s", "error"), ("env_tau_beta_magnitude", "w", "warning"), ("no_gains", None, "error")]


def test_publish_only_accepted_sites(spark, tmp_path):
    taus = spark.createDataFrame([(1, "a", 45.0), (2, "a", 45.0)], "site_id bigint, sensor string, tau_base double")
    gains = spark.createDataFrame([(1, "e", False), (2, "e", True)], "site_id bigint, effector string, negligible boolean")
    assert g.publish_fit({"taus": taus, "gains": gains}, str(tmp_path), "f1")
    assert rows(spark.read.parquet(f"{tmp_path}/taus"), "site_id", "fit_id") == [(1, "f1")]
    assert not g.publish_fit({"taus": taus, "gains": gains.filter("negligible")}, str(tmp_path), "f2")
