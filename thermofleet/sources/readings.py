"""The long readings table: scan, insert-or-ignore, upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermofleet.functions.timekeys import as_timestamp
from thermofleet.operators.spans import keep_first, keep_last
from thermofleet.session import scratch_path

READING_KEY = ("site_id", "ts", "name")


def read_readings(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Readings in `[since, until]`. With a `dt` partition column the range also prunes folders."""
    df = spark.read.parquet(path).withColumn("ts", as_timestamp(F.col("ts")))
    if "dt" in df.columns:
        if since is not None:
            df = df.filter(F.col("dt") >= F.to_date(F.lit(since)))
        if until is not None:
            df = df.filter(F.col("dt") <= F.to_date(F.lit(until)))
    return slice_time(df, F.lit(since).cast("timestamp") if since else None, F.lit(until).cast("timestamp") if until else None)


def slice_time(df: DataFrame, lo: Column | None = None, hi: Column | None = None, ts: str = "ts") -> DataFrame:
    """Inclusive time range; literal bounds reach the file scan."""
    if lo is not None:
        df = df.filter(F.col(ts) >= lo)
    if hi is not None:
        df = df.filter(F.col(ts) <= hi)
    return df


def names_like(df: DataFrame, pattern: str | None = None, contains: str | None = None) -> DataFrame:
    """SQL pattern, or case-insensitive substring."""
    if pattern is not None:
        df = df.filter(F.col("name").like(pattern))
    if contains is not None:
        df = df.filter(F.lower("name").contains(contains.lower()))
    return df


def new_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = READING_KEY, arrival: str = "arrival") -> DataFrame:
    """Incoming rows to append: the first to arrive per key, and none whose key is already stored."""
    first = keep_first(incoming, keys, arrival)
    return first.join(existing.select(*keys), list(keys), "left_anti")


def append_new(existing: DataFrame, incoming: DataFrame, path: str, keys: Sequence[str] = READING_KEY,
               arrival: str = "arrival") -> None:
    """Append to a table that is partitioned by day. Only the days that the incoming rows touch are read.

    Equal keys have equal days. The days of a batch are few values; they become a partition filter of the scan.
    """
    dated = incoming.withColumn("dt", F.to_date("ts"))
    stored = existing if "dt" in existing.columns else existing.withColumn("dt", F.to_date("ts"))
    first, last = dated.agg(F.min("dt"), F.max("dt")).first()
    days = F.lit(False) if first is None else F.col("dt").between(F.lit(first), F.lit(last))
    touched = stored.filter(days).join(dated.select("dt").distinct(), "dt", "left_semi")
    rows = new_rows(touched, dated, [*keys, "dt"], arrival).drop(arrival)
    rows.write.mode("append").partitionBy("dt").parquet(path)


def upsert_by_key(base: DataFrame, updates: DataFrame, keys: Sequence[str], arrival: str | None = None) -> DataFrame:
    """Updated rows replace stored rows of the same key; columns a side lacks read NULL.

    Of several updates of a key the last by `arrival` counts; without it updates hold one row per key.
    """
    if arrival is not None:
        updates = keep_last(updates, keys, arrival).drop(arrival)
    return base.join(updates.select(*keys), list(keys), "left_anti").unionByName(updates, allowMissingColumns=True)


def upsert_days(updates: DataFrame, path: str, keys: Sequence[str], batch: int, arrival: str | None = None, ts: str = "ts") -> bool:
    """Upsert into a table partitioned by day (`dt`), copy on write: only the days that the updates touch are read and rewritten.

    Keys include the time, so equal keys have equal days. A batch enters the ledger beside the table after its days are
    written: a batch that comes again is left out (False), and one that was broken off writes the same rows once more.
    """
    spark, ledger = updates.sparkSession, f"{path}/_batches"
    seen = spark.createDataFrame([], "batch bigint") if not path_exists(spark, ledger) else spark.read.parquet(ledger)
    if not seen.filter(F.col("batch") == batch).isEmpty():
        return False
    dated = updates.withColumn("dt", F.to_date(ts))
    days = [r[0] for r in dated.select("dt").distinct().collect()]  # a batch touches few days
    stored = spark.read.parquet(path) if partition_values(spark, path, "dt") else None
    if stored is None:
        base = dated.drop(*([arrival] if arrival else [])).limit(0)
    else:
        base = stored.filter(F.col("dt").isin(days) | (F.col("dt").isNull() if None in days else F.lit(False)))
    merged = upsert_by_key(base, dated, [*keys, "dt"], arrival)
    staged = scratch_path(spark, "upsert")  # Spark does not overwrite a folder it reads from
    merged.write.parquet(staged)
    replace_partitions(spark.read.schema(merged.schema).parquet(staged), path)
    spark.range(1).select(F.lit(batch).cast("bigint").alias("batch"), F.lit(len(days)).alias("n_days")).write.mode("append").parquet(ledger)
    return True


def replace_partitions(df: DataFrame, path: str, partition: str = "dt") -> None:
    """Rewrite only the partitions present in `df`."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """The values of a partition column that have a folder, in order."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    return sorted(n.partition("=")[2] for n in names if n.startswith(f"{column}="))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
