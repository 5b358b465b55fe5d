"""The corpus pipeline: quality rules, line dedup, near-duplicate dedup, source mixing, packing."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from thermofleet.llm import lines, mixing, packing, quality, simhash  # noqa: E402
from thermofleet.llm.queries import tokenizer_path  # noqa: E402
from thermofleet.llm.tables import documents, stored  # noqa: E402
from thermofleet.session import apply_settings, ship_package  # noqa: E402


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    apply_settings(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    _ready(spark)
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose repeated long lines; a document left without a word goes."""
    _ready(spark)
    kept = lines.without_lines(docs).withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")})
    return kept.where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    _ready(spark)
    return simhash.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of small sources are repeated up to the limit."""
    _ready(spark)
    return mixing.mixed_documents(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    _ready(spark)
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_dedup),
    ("source_mix", source_mix), ("best_fit_packing", best_fit),
]

ORACLE_SQL = None  # tokens and 64-bit hashes have no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
