"""Fitted-parameter documents to flat tables, accepting the names older documents used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermofleet import schemas


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; `fit_id` is its file name."""
    docs = spark.read.schema(schemas.FITTED_PARAMETERS).option("multiLine", "true").json(path)
    return docs.withColumn("fit_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))


def taus(docs: DataFrame) -> DataFrame:
    rows = docs.select("fit_id", F.explode("fitted_taus").alias("t"))
    return rows.select("fit_id", "t.sensor", "t.tau_base", "t.n_segments")


def tau_betas(docs: DataFrame) -> DataFrame:
    rows = docs.select("fit_id", F.explode("fitted_taus").alias("t"))
    betas = F.coalesce("t.environment_tau_betas", "t.advisory_tau_betas", "t.window_betas")
    return rows.select("fit_id", "t.sensor", F.explode(betas).alias("device", "beta")).withColumn("kind", F.lit("tau"))


def gains(docs: DataFrame) -> DataFrame:
    return docs.select("fit_id", F.explode("effector_sensor_gains").alias("g")).select("fit_id", "g.*")


def solar_gains(docs: DataFrame) -> DataFrame:
    return docs.select("fit_id", F.explode("solar_elevation_gains").alias("sensor", "gain"))


def solar_betas(docs: DataFrame) -> DataFrame:
    nested = F.coalesce("environment_solar_betas", "advisory_solar_betas")
    rows = docs.select("fit_id", F.explode(nested).alias("device", "inner"))
    return rows.select("fit_id", "device", F.explode("inner").alias("sensor", "beta")).withColumn("kind", F.lit("solar"))


def usable_gains(gain_rows: DataFrame, effectors: DataFrame, min_t: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Gains a planner may use: significant, of the sign the device can produce, clamped.

    `effectors` has `(site_id, name, supported_modes)`; a gain of an unlisted effector is kept.
    """
    modes = effectors.select("site_id", F.col("name").alias("effector"), "supported_modes")
    joined = gain_rows.filter(
        ~F.col("negligible") & (F.abs(F.coalesce("t_statistic", F.lit(999.0))) >= min_t)
    ).join(modes, ["site_id", "effector"], "left")
    heats, cools = F.array_contains("supported_modes", "heat"), F.array_contains("supported_modes", "cool")
    gain = F.col("gain_f_per_hour")
    wrong = F.coalesce((heats & ~cools & (gain < 0)) | (cools & ~heats & (gain > 0)), F.lit(False))
    return joined.filter(~wrong).withColumn(
        "gain_f_per_hour", F.greatest(F.lit(-cap), F.least(F.lit(cap), gain))
    ).drop("supported_modes")
