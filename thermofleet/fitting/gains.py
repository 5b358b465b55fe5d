"""Reading effector gains and environment effects off the coefficients, and judging them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermofleet.functions.bands import change_direction, metric_verdict, percent_change
from thermofleet.functions.labels import lag_midpoint
from thermofleet.operators.aggregates import direct_and_cross
from thermofleet.operators.lookup import compare_common, compare_versions

KEYS = ("site_id", "sensor")
LAG_NAME = r"^lag_(.+)_(\d+_\d+)$"


def effector_gains(coefs: DataFrame, by: Sequence[str] = KEYS, small: float = 0.05, t_limit: float = 2.0) -> DataFrame:
    """Gain = sum of an effector's lag coefficients; lag and t come from its strongest bin.

    Negligible: small and insignificant at once.
    """
    lags = coefs.filter(F.col("feature").startswith("lag_")).withColumns(
        {
            "effector": F.regexp_extract("feature", LAG_NAME, 1),
            "bin": F.regexp_extract("feature", LAG_NAME, 2),
            "__rank": F.struct(F.abs("beta"), -F.col("feature_no")),
        }
    )
    out = lags.groupBy(*by, "effector").agg(
        F.sum("beta").alias("__gain"), F.max_by("bin", "__rank").alias("__bin"), F.max_by("t", "__rank").alias("__t")
    )
    return out.select(
        *by, "effector", F.round("__gain", 4).alias("gain_f_per_hour"), lag_midpoint(F.col("__bin")).alias("best_lag_minutes"),
        F.round("__t", 2).alias("t_statistic"),
        ((F.abs("__gain") < small) & (F.abs("__t") < t_limit)).alias("negligible"),
    )


def no_gains(sensors: DataFrame, effectors: Sequence[str], fits: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Zero, negligible gains for groups that had too few rows to fit."""
    missing = sensors.select(*by).join(fits.select(*by), list(by), "left_anti")
    return missing.select(
        *by, F.explode(F.array(*[F.lit(e) for e in effectors])).alias("effector"), F.lit(0.0).alias("gain_f_per_hour"),
        F.lit(0.0).alias("best_lag_minutes"), F.lit(0.0).alias("t_statistic"), F.lit(True).alias("negligible"),
    )


def environment_betas(coefs: DataFrame, cvs: DataFrame | None = None, by: Sequence[str] = KEYS, t_limit: float = 2.0) -> DataFrame:
    """Kept environment effects: exchange effects need a positive coefficient, solar ones only significance.

    `unstable` marks kept ones whose bootstrap spread exceeds their mean.
    """
    rows = coefs.filter(F.col("feature").startswith("adv_"))
    kind = F.regexp_extract("feature", "^adv_(tau|solar)_", 1)
    rows = rows.withColumns({"kind": kind, "device": F.regexp_replace("feature", "^adv_(tau|solar)_", "")})
    kept = rows.filter((F.abs("t") >= t_limit) & ((F.col("kind") == "solar") | (F.col("beta") > 0)))
    if cvs is not None:
        kept = kept.join(cvs, [*by, "feature"], "left")
    else:
        kept = kept.withColumn("cv", F.lit(None).cast("double"))
    beta = F.when(F.col("kind") == "tau", F.round("beta", 6)).otherwise(F.round("beta", 4))
    return kept.select(*by, "device", "kind", beta.alias("beta"), F.coalesce(F.col("cv") > 1.0, F.lit(False)).alias("unstable"))


def solar_gain(coefs: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    return coefs.filter(F.col("feature") == "solar_elev").select(
        *by, F.round("beta", 4).alias("gain"), F.round("t", 2).alias("t_statistic")
    )


def result_issues(taus: DataFrame, betas: DataFrame, solar: DataFrame, gains: DataFrame) -> DataFrame:
    """Implausible fitted values as issue rows `(site_id, check, sensor, device, severity, value, bound)`."""
    envelope = betas.filter(F.col("kind") == "tau").join(taus, ["site_id", "sensor"])
    fast = F.lit(1.0) / (F.lit(1.0) / F.col("tau_base") + F.col("beta"))
    a = envelope.filter(F.col("beta") > 2.0 / F.col("tau_base")).select(
        "site_id", F.lit("env_tau_beta_magnitude").alias("check"), "sensor", "device",
        F.when(fast < 1.0, "error").otherwise("warning").alias("severity"), F.col("beta").alias("value"),
        (F.lit(2.0) / F.col("tau_base")).alias("bound"),
    )
    bound = F.greatest(F.abs(F.coalesce("gain", F.lit(0.0))) * 2.0, F.lit(1.0))
    b = betas.filter(F.col("kind") == "solar").join(solar.select("site_id", "sensor", "gain"), ["site_id", "sensor"], "left").filter(
        F.abs("beta") > bound
    ).select(
        "site_id", F.lit("env_solar_beta_magnitude").alias("check"), "sensor", "device", F.lit("error").alias("severity"),
        F.col("beta").alias("value"), bound.alias("bound"),
    )
    empty = F.lit("").alias("sensor"), F.lit(None).cast("string").alias("device")
    none = F.lit(None).cast("double")
    sites = gains.select("site_id").unionByName(taus.select("site_id")).distinct()
    c = sites.join(taus.select("site_id").distinct(), ["site_id"], "left_anti").select(
        "site_id", F.lit("no_taus").alias("check"), *empty, F.lit("error").alias("severity"), none.alias("value"), none.alias("bound")
    )
    d = sites.join(gains.filter(~F.col("negligible")).select("site_id").distinct(), ["site_id"], "left_anti").select(
        "site_id", F.lit("no_gains").alias("check"), *empty, F.lit("error").alias("severity"), none.alias("value"), none.alias("bound")
    )
    return a.unionByName(b).unionByName(c).unionByName(d)


def collinearity_issues(coefs: DataFrame, by: Sequence[str] = KEYS, warn: float = 10.0, error: float = 50.0) -> DataFrame:
    rows = coefs.filter(F.col("feature").startswith("adv_") | F.col("feature").startswith("solar_"))
    return rows.filter(F.col("vif") > warn).select(
        *by, "feature", "vif", F.when(F.col("vif") > error, "error").otherwise("warning").alias("severity")
    )


def health_grade(diagnostics: DataFrame) -> DataFrame:
    """Grades A, B, C, F and the reasons, from `(r_squared, durbin_watson, n_segments, n_gains, n_unstable_kept,
    holdout_degradation, has_errors)`.

    F: no segment, validation errors, no gain or R2 below 0.02. A: R2 >= .08, DW >= .20, 5 segments, holdout at
    most 20 % worse, nothing unstable kept. B: R2 >= .04, DW >= .10, 3 segments, holdout at most 35 % worse.
    """
    r2, dw, seg = F.col("r_squared"), F.col("durbin_watson"), F.col("n_segments")
    out = F.col("holdout_degradation")

    def held(limit: float) -> Column:
        return out.isNull() | (out <= limit)

    stop = (seg == 0) | F.col("has_errors")
    weak = (F.col("n_gains") == 0) | (r2 < 0.02)
    is_a = (r2 >= 0.08) & (dw >= 0.20) & (seg >= 5) & (F.col("n_unstable_kept") == 0) & held(0.20)
    is_b = (r2 >= 0.04) & (dw >= 0.10) & (seg >= 3) & held(0.35)
    grade = F.when(stop | weak, "F").when(is_a, "A").when(is_b, "B").otherwise("C")
    none = F.array().cast("array<string>")
    notes = (
        F.when(stop, F.array(F.when(seg == 0, "no segments").otherwise("validation errors")))
        .when(weak, F.array_compact(F.array(F.when(F.col("n_gains") == 0, "no significant gains"), F.when(r2 < 0.02, "low R2"))))
        .when(is_a, none)
        .otherwise(F.array_compact(F.array(
            F.when(r2 < 0.08, "low R2"), F.when(dw < 0.20, "low DW"), F.when(seg < 5, "few segments"),
            F.when(F.col("n_unstable_kept") > 0, "unstable kept"), F.when(out > 0.20, "holdout worse"),
        )))
    )
    return diagnostics.withColumn("grade", grade).withColumn("notes", notes)


def gain_drift(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("site_id", "effector", "sensor")) -> DataFrame:
    """Gains that moved by more than half since the last fit; pairs below 0.05 on both sides are ignored."""

    def live(df: DataFrame) -> DataFrame:
        return df.filter(~F.col("negligible"))

    both = compare_versions(live(old), live(new), keys, "gain_f_per_hour")
    o, n = F.col("old_value"), F.col("new_value")
    change = F.when(F.abs(o) > 1e-6, F.abs(n - o) / F.abs(o)).when(F.abs(n) > 0.05, F.lit(float("inf"))).otherwise(0.0)
    return both.filter(~((F.abs(o) < 0.05) & (F.abs(n) < 0.05)) & (change > 0.5))


def acceptable_sites(taus: DataFrame, gains: DataFrame) -> DataFrame:
    """Sites whose fit may be published: some time constant and some significant gain."""
    return taus.select("site_id").distinct().join(
        gains.filter(~F.col("negligible")).select("site_id").distinct(), ["site_id"], "left_semi"
    )


def publish_fit(tables: Mapping[str, DataFrame], folder: str, fit_id: str) -> bool:
    """Write the four tables of accepted sites under a new `fit_id` partition; false when no site passes."""
    accepted = acceptable_sites(tables["taus"], tables["gains"])
    if accepted.isEmpty():
        return False
    for name, df in tables.items():
        df.join(accepted, ["site_id"], "left_semi").write.mode("errorifexists").parquet(f"{folder}/{name}/fit_id={fit_id}")
    return True


def experiment_summary(gains: DataFrame, quality: DataFrame) -> DataFrame:
    """Mean R2 and DW, mean direct and cross gains and their ratio, per site."""
    split = direct_and_cross(gains)
    direct = split.filter(F.col("direct_sensor") != "(none)").groupBy("site_id").agg(
        F.avg(F.abs("direct_gain")).alias("mean_direct"),
        (F.sum(F.col("mean_cross_gain") * F.col("n_cross"))).alias("__cross"), F.sum("n_cross").alias("__n"),
    )
    cross = F.when(F.col("__n") > 0, F.col("__cross") / F.col("__n")).otherwise(0.0)
    means = quality.groupBy("site_id").agg(F.avg("r_squared").alias("mean_r2"), F.avg("durbin_watson").alias("mean_dw"))
    joined = means.join(direct, ["site_id"], "left").withColumns(
        {"mean_direct": F.coalesce("mean_direct", F.lit(0.0)), "mean_cross": F.coalesce(cross, F.lit(0.0))}
    )
    ratio = F.when(F.col("mean_direct") > 0, F.col("mean_cross") / F.col("mean_direct")).otherwise(0.0)
    return joined.withColumn("cross_direct_ratio", ratio).drop("__cross", "__n")


def compare_experiments(baseline: DataFrame, variant: DataFrame) -> DataFrame:
    """Long rows `(site_id, metric, old, new, percent, direction, verdict)` for two summaries."""
    wants = {"mean_r2": "keep", "mean_dw": "keep", "mean_direct": "stable", "mean_cross": "lower", "cross_direct_ratio": "lower"}
    both = compare_common(baseline, variant, ["site_id"], list(wants))
    items = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(w).alias("want"), F.col(f"old_{m}").alias("old"), F.col(f"new_{m}").alias("new"))
        for m, w in wants.items()
    ])
    rows = both.select("site_id", F.explode(items).alias("m")).select("site_id", "m.*")
    pct = percent_change(F.col("old"), F.col("new"))
    return rows.select(
        "site_id", "metric", "old", "new", pct.alias("percent"), change_direction(pct).alias("direction"),
        metric_verdict(F.col("want"), F.col("old"), F.col("new")).alias("verdict"),
    )


def cross_gain_movers(baseline: DataFrame, variant: DataFrame, top: int = 15) -> DataFrame:
    """Gains on both sides that shrank most."""
    both = compare_common(baseline, variant, ["site_id", "effector", "sensor"], ["gain_f_per_hour"])
    delta = F.abs("new_gain_f_per_hour") - F.abs("old_gain_f_per_hour")
    return both.withColumn("delta", delta).orderBy("delta", "site_id", "effector", "sensor").limit(top)
