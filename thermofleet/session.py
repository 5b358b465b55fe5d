"""Session defaults and the shared folder used for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Cluster sizing (cores, memory, shuffle partitions) stays with the caller.
JOB_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Set when a session is built: files of a checkpoint go as soon as nothing refers to it.
BUILD_SETTINGS = {**JOB_SETTINGS, "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def build_session(master: str | None = None, app: str = "thermofleet", **extra: str) -> SparkSession:
    """Session with the settings above; `extra` uses `__` for dots (`spark__driver__memory="8g"`)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**BUILD_SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the SQL settings on a session somebody else built."""
    for key, value in JOB_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package: their Python workers import it for the numpy steps and keyed state.

    The archive goes out through Spark's own file distribution, once per application; jobs submitted with
    `--py-files` do not need it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="thermofleet-package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`. Without the setting only a local master may use a folder of its machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named is None and current is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if named is None:
        named = current or tempfile.mkdtemp(prefix="thermofleet-checkpoints-")
    if current is None:
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the checkpoint root, for tables a job writes and reads back."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (never on executor-local disks)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
