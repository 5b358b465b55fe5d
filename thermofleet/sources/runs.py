"""Run-metric documents: one JSON file per training run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermofleet import schemas
from thermofleet.functions.labels import parse_target


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Readable runs with their file name; malformed documents are skipped."""
    docs = (
        spark.read.schema(schemas.RUN_METRICS)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(folder)
        .withColumn("file", F.col("_metadata.file_name"))
    )
    return docs.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def run_targets(runs: DataFrame) -> DataFrame:
    """One row per run and target with room and horizon label."""
    rows = runs.select(*[c for c in runs.columns if c != "targets"], F.explode("targets").alias("t"))
    room, horizon = parse_target(F.col("t.target"))
    return rows.select(
        *[c for c in runs.columns if c != "targets"], "t.target", room.alias("room"), horizon.alias("horizon"),
        "t.rmse", "t.mae", "t.n_train", "t.n_val",
    )


def find_run(runs: DataFrame, prefix: str) -> DataFrame:
    """Runs whose file name starts with the prefix; the earliest is the match."""
    return runs.filter(F.col("file").startswith(prefix)).orderBy("timestamp", "file").limit(1)


def run_history(runs: DataFrame) -> DataFrame:
    """Every run with its label and mean errors, in time order per label."""
    label = F.when(F.col("experiment").isNull() | (F.col("experiment") == ""), F.col("mode")).otherwise(
        F.concat_ws("/", "mode", "experiment")
    )

    def mean(field: str):
        total = F.aggregate("targets", F.lit(0.0), lambda acc, t: acc + t[field])
        return F.when(F.size("targets") > 0, total / F.size("targets")).otherwise(0.0)

    return runs.select(
        label.alias("label"), "timestamp", "file", F.coalesce("git_hash", F.lit("?")).alias("git_hash"),
        F.coalesce(F.col("data.rows_raw"), F.lit(0)).alias("rows_raw"),
        F.coalesce(F.col("data.n_features"), F.lit(0)).alias("n_features"),
        mean("rmse").alias("mean_rmse"), mean("mae").alias("mean_mae"),
    )
