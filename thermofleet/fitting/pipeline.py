"""Readings to fitted parameters, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermofleet.fitting import gains as g
from thermofleet.fitting import ridge as r
from thermofleet.fitting.prepare import Layout, design, prepare, sensor_rows, uncontrolled_segments
from thermofleet.fitting.tau import fit_segments, sensor_taus
from thermofleet.operators.spans import durbin_watson
from thermofleet.operators.track import Track
from thermofleet.session import cut_lineage


@dataclass(frozen=True)
class Fit:
    taus: DataFrame
    gains: DataFrame
    betas: DataFrame
    solar: DataFrame
    issues: DataFrame
    health: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"taus": self.taus, "gains": self.gains, "env_betas": self.betas, "solar_gains": self.solar}


def fit_sites(wide: DataFrame, layout: Layout, default_tau: float = 45.0, min_segment_rows: int = 12,
              gap_seconds: float = 600, min_rows: int = 500, holdout_rows: int = 1_000, replicates: int = 50,
              min_outdoor: int = 100) -> Fit:
    """Fit every site and sensor of a wide grid `(site_id, ts, …)`.

    Prepared rows, design rows and the coefficient table are cut into the shared checkpoint folder because each
    feeds several results.
    """
    rows = cut_lineage(sensor_rows(prepare(wide, layout, min_outdoor), layout))
    sensors = rows.select("site_id", "sensor").distinct().withColumn("default_tau", F.lit(float(default_tau)))
    segments = uncontrolled_segments(rows, layout, gap_seconds, min_segment_rows)
    taus = cut_lineage(sensor_taus(fit_segments(segments, ["site_id", "sensor", "segment_id"]), sensors))

    matrix, features = design(rows, taus, layout)
    matrix = cut_lineage(matrix)
    fits = cut_lineage(r.ridge(matrix, features, min_rows=min_rows))
    coefs = r.coefficients(fits, features)
    cvs = r.bootstrap_cv(matrix, fits, features, replicates=replicates, min_rows=min_rows)
    held = r.holdout(matrix, fits, min_rows=holdout_rows)
    dw = durbin_watson(r.with_residuals(matrix, fits), Track(("site_id", "sensor")), "residual")

    found = g.effector_gains(coefs).unionByName(
        g.no_gains(sensors, [e.name for e in layout.effectors], fits)
    ) if layout.effectors else g.effector_gains(coefs)
    betas = g.environment_betas(coefs, cvs)
    solar = g.solar_gain(coefs)
    issues = g.result_issues(taus, betas, solar, found)

    keys = ["site_id", "sensor"]
    errors = issues.filter((F.col("severity") == "error") & (F.col("sensor") != "")).select(*keys).unionByName(
        g.collinearity_issues(coefs).filter(F.col("severity") == "error").select(*keys)
    ).distinct().withColumn("has_errors", F.lit(True))
    n_gains = found.filter(~F.col("negligible")).groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n_gains"))
    unstable = betas.filter("unstable").groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n_unstable_kept"))
    zero = F.lit(0)
    diagnostics = (
        taus.join(fits.select(*keys, "r_squared"), keys, "left")
        .join(dw, keys, "left")
        .join(n_gains, keys, "left")
        .join(unstable, keys, "left")
        .join(held.select(*keys, F.col("degradation").alias("holdout_degradation")), keys, "left")
        .join(errors, keys, "left")
        .withColumns(
            {
                "r_squared": F.coalesce("r_squared", F.lit(0.0)),
                "durbin_watson": F.coalesce("durbin_watson", F.lit(0.0)),
                "n_gains": F.coalesce("n_gains", zero),
                "n_unstable_kept": F.coalesce("n_unstable_kept", zero),
                "has_errors": F.coalesce("has_errors", F.lit(False)),
            }
        )
    )
    return Fit(taus, found, betas, solar, issues, g.health_grade(diagnostics))
