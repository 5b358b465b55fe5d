"""The decision log: parsing landed rows and building new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermofleet import schemas


def parse_decisions(rows: DataFrame) -> DataFrame:
    """JSON text columns to typed ones. Columns an older file lacks read NULL, and so does unreadable text."""
    plain = [
        (F.col(c).try_cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c)
        for c, t in schemas.DECISION_PLAIN.items()
    ]
    parsed = [
        (F.from_json(F.col(c), t) if c in rows.columns else F.lit(None).cast(t)).alias(c)
        for c, t in schemas.DECISION_JSON.items()
    ]
    return rows.select(*plain, *parsed)


def read_decisions(spark: SparkSession, path: str, limit: int | None = None, since: str | None = None) -> DataFrame:
    """Decisions since a time, or the newest `limit` of them."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    if since is not None:
        rows = rows.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    if limit is not None:
        rows = rows.orderBy(F.col("ts").desc(), F.col("site_id")).limit(limit)
    return parse_decisions(rows)


def bounds_struct(prefix: str = "") -> Column:
    """Comfort bounds of one label as a map, with the `min`/`max` names older readers look for."""
    names = {
        "min": "acc_lo", "max": "acc_hi", "preferred_lo": "pref_lo", "preferred_hi": "pref_hi",
        "acceptable_lo": "acc_lo", "acceptable_hi": "acc_hi", "backup_lo": "backup_lo", "backup_hi": "backup_hi",
        "cold_penalty": "cold_penalty", "hot_penalty": "hot_penalty",
    }
    return F.create_map(*[x for k, c in names.items() for x in (F.lit(k), F.col(f"{prefix}{c}").cast("double"))])


def bounds_map(entries: DataFrame, by: tuple[str, ...] = ("site_id", "ts")) -> DataFrame:
    """Schedule entries in force per decision as label -> bounds (bounded by a site's constraints)."""
    return entries.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("label"), bounds_struct()))).alias("comfort_bounds")
    )


def radiant_offsets(weights: Column, base_offset: Column) -> Column:
    """Base offset plus one per label, three decimals; NULL below 0.05 degrees."""
    scaled = F.transform_values(weights, lambda _, w: F.round(base_offset * w, 3))
    offsets = F.map_concat(F.create_map(F.lit("_base"), F.round(base_offset, 3)), scaled)
    return F.when(F.abs(base_offset) >= 0.05, offsets)


def merged_reasons(ineligible: Column, blocked: Column) -> Column:
    """One map of blocked effectors; the physical reason replaces the eligibility one. NULL when empty."""
    empty = F.create_map().cast("map<string,string>")
    first, second = F.coalesce(ineligible, empty), F.coalesce(blocked, empty)
    kept = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    merged = F.map_concat(kept, second)
    return F.when(F.size(merged) > 0, merged)


def decision_rows(decisions: DataFrame) -> DataFrame:
    """Typed decisions to landed form: nested columns as JSON text, outcome open."""
    columns = []
    for c in decisions.columns:
        columns.append(F.to_json(F.col(c)).alias(c) if c in schemas.DECISION_JSON else F.col(c))
    out = decisions.select(*columns)
    return out.withColumn("outcome_backfilled", F.lit(False))
