"""The Merkle manifest against its plain version, with several rounds of blocks, and what tampering shows."""

import zlib
from collections import Counter

import pytest
from llm import brute
from pyspark.sql import functions as F

from thermofleet.llm import merkle, ranks

OUT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def touched(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0


def fields(rows):
    return [(d, s, lang, len(t or ""), t) for d, t, lang, s in rows]


def test_messy_rows(docs, rows, none):
    found = merkle.verified(docs).select(*OUT)
    assert Counter(tuple(r) for r in found.collect()) == Counter(brute.merkle(fields(rows), touched))
    assert merkle.verified(none).count() == 0


@pytest.mark.parametrize(("fan_out", "levels"), [(3, 1), (2, 3)])
def test_many_rounds_of_small_blocks(spark, fan_out, levels):
    """Blocks of a few rows: several rounds within a group, a hot group, single leaves, and more groups than a block holds."""
    rows = [(k, "hot" if k % 3 == 0 else f"g{k % 40}", None, k, f"line\n{k}") for k in range(150)] + [(7, "hot", None, 7, "line\n7")] * 5
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.manifest(df, carried=merkle.tampered_leaf(), fan_out=fan_out, levels=levels)
    again = merkle.folded(F.coalesce("carried", "leaf"), F.col("path"))
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")), again, again == F.col("root"))
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute.merkle(rows, touched, fan_out))


def test_only_changed_rows_fail(docs):
    bad = merkle.verified(docs).where("not verified").select("doc_id").collect()
    assert bad and all(touched(r["doc_id"]) for r in bad)


def test_numbers_of_a_hot_group_with_equal_rows(spark):
    df = spark.createDataFrame([(None, 1)] * 300 + [("a", k % 4) for k in range(200)], "g string, v int")
    got = ranks.numbered(df.repartition(7), ["g"], [F.col("v")]).collect()
    for g, n in ((None, 300), ("a", 200)):
        own = sorted((r["rank"], r["v"]) for r in got if r["g"] == g)
        assert [r for r, _ in own] == list(range(n)) and [v for _, v in own] == sorted(v for _, v in own)
        assert {r["n"] for r in got if r["g"] == g} == {n}


def test_no_join_in_the_plan(docs):
    plan = merkle.verified(docs)._jdf.queryExecution().toString()
    assert "Join" not in plan
