"""Hourly forecasts landed as JSON service responses, one document per line or file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermofleet import schemas


def forecast_rows(responses: DataFrame, entity: str | None = None) -> DataFrame:
    """`(site_id, issued_at, body)` to one row per forecast point.

    The body may be wrapped in `service_response`; below it sits one object per weather entity. Numbers are
    optional, the temperature is not: points without one, or without a readable time, are dropped.
    """
    per_entity = f"map<string,struct<forecast:array<struct<{_fields()}>>>>"
    wrapped = F.from_json(F.get_json_object("body", "$.service_response"), per_entity)
    bare = F.from_json("body", per_entity)
    exploded = responses.select("site_id", "issued_at", F.explode(F.coalesce(wrapped, bare)).alias("entity", "reply"))
    if entity is not None:
        exploded = exploded.filter(F.col("entity") == entity)
    points = exploded.select("site_id", "issued_at", F.explode("reply.forecast").alias("p"))
    return points.select(
        "site_id",
        "issued_at",
        F.try_to_timestamp(F.col("p.datetime")).alias("target_ts"),
        F.col("p.temperature").try_cast("double").alias("temperature"),
        F.coalesce(F.col("p.condition"), F.lit("unknown")).alias("condition"),
        *[F.col(f"p.{c}").try_cast("double").alias(c) for c in ("wind_speed", "cloud_coverage", "precipitation")],
    ).filter(F.col("target_ts").isNotNull() & F.col("temperature").isNotNull())


def _fields() -> str:
    return ",".join(":".join(f.strip().split(" ")) for f in schemas.FORECAST_ENTRY.split(","))


def read_forecast(spark: SparkSession, path: str, entity: str | None = None) -> DataFrame:
    """Files of `{"site_id":…, "issued_at":…, "body": "<response json>"}` lines."""
    landed = spark.read.schema("site_id bigint, issued_at timestamp, body string").json(path)
    return forecast_rows(landed, entity)


def hourly_array(forecast: DataFrame, by: tuple[str, ...] = ("site_id", "issued_at")) -> DataFrame:
    """Outdoor temperatures of one issue as an array in time order (a forecast holds a day or two of hours)."""
    points = F.sort_array(F.collect_list(F.struct("target_ts", "temperature")))
    return forecast.groupBy(*by).agg(F.transform(points, lambda p: p["temperature"]).alias("outdoor"))
