"""Structured Streaming sources, sinks, and jobs on Spark's own windows.

Spark drops what comes behind the watermark (15 minutes unless the caller says otherwise) from the windows and sessions
here; the jobs of `streaming.ordered` hand such rows out instead, to be merged. State is keyed by site and name. Files per
trigger (16 unless the caller says otherwise) bound what a micro-batch brings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermofleet import schemas
from thermofleet.functions.timekeys import add_seconds, round5
from thermofleet.sources.readings import READING_KEY
from thermofleet.sources.states import states_to_readings

LATE = "15 minutes"


def read_states(spark: SparkSession, folder: str, max_files: int = 16) -> DataFrame:
    """Landed state JSON as a stream."""
    return spark.readStream.schema(schemas.ENTITY_STATES).option("maxFilesPerTrigger", max_files).json(folder)


def _status(spark: SparkSession, path: str):
    """The Hadoop file status of a path, or None where nothing is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getFileStatus(where) if files.exists(where) else None


def read_readings(spark: SparkSession, path: str, schema: str = schemas.READINGS, max_files: int = 16) -> DataFrame:
    """A parquet table as a stream: a folder of part files, or one file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    status = _status(spark, path)
    if status is not None and status.isFile():
        folder, _, name = path.rstrip("/").rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def ingest(states: DataFrame, dims: DataFrame, late: str = LATE, zero_fill: bool = False) -> DataFrame:
    """States to readings on five-minute keys; the first row of a key wins."""
    readings = states_to_readings(states, dims, zero_fill=zero_fill).withColumn("ts", round5(F.col("ts")))
    return first_write_wins(readings, late)


def first_write_wins(readings: DataFrame, late: str = LATE) -> DataFrame:
    return readings.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(READING_KEY))


def rollup(readings: DataFrame, by: Sequence[str] = ("site_id", "name"), width: str = "5 minutes", shift_seconds: int = 120,
           late: str = LATE) -> DataFrame:
    """Aggregates per five-minute key. Keys round to the nearest mark and windows floor, hence the shift."""
    whole = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 60) * 60)
    shifted = readings.withColumn("at", add_seconds(whole, shift_seconds)).withWatermark("at", late)
    number = F.col("value").try_cast("double")
    return shifted.groupBy(*by, F.window("at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(number).alias("mean_value"), F.min(number).alias("min_value"),
        F.max(number).alias("max_value"),
    ).select(*by, F.col("w.start").alias("ts"), "n_rows", "mean_value", "min_value", "max_value")


def gap_sessions(readings: DataFrame, by: Sequence[str] = ("site_id", "name"), gap: str = "10 minutes", late: str = LATE) -> DataFrame:
    marked = readings.withWatermark("ts", late)
    return marked.groupBy(*by, F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")
    ).drop("w")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has landed so far into parquet and stop; the next call goes on from there."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def append_new_batches(stream: DataFrame, out: str, checkpoint: str, keys: Sequence[str] = READING_KEY, arrival: Column | None = None):
    """Insert-or-ignore sink: each micro-batch appends only keys the table does not hold yet.

    The table is partitioned by day and a batch reads only the days it touches, all of their keys: a batch that is run
    again after its append finds its own rows there and adds nothing.
    """
    from thermofleet.sources.readings import append_new

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        incoming = batch.withColumn("arrival", arrival if arrival is not None else F.monotonically_increasing_id())
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in batch.schema.fields)}, dt date"
        stored = spark.read.schema(schema).parquet(out) if _status(spark, out) else spark.createDataFrame([], schema)
        append_new(stored, incoming, out, keys)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
