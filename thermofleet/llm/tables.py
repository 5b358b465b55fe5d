"""Tables a job writes to the shared folder and reads back, and column expressions several operators use."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from thermofleet.session import scratch_path

# The white space of all contracts (space and U+0009 to U+000D), and the ASCII letters.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` under the checkpoint folder and read it back: a cut that survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], buckets: int, label: str) -> DataFrame:
    """Stored in the shared folder, dealt and sorted by the keys: what is joined with it by these keys moves, the table does not."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", scratch_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII takes the fast built-in, which is the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The runs of non-blank characters; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def n_words(text: Column) -> Column:
    """Number of words without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
