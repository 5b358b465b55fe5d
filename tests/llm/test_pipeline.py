"""The pipeline's stages against plain versions, and the rest of the package without them."""

from collections import Counter

import corpus_pipeline as pipeline
import pytest
from llm import brute

from thermofleet.llm.queries import tokenizer_path
from thermofleet.llm.tables import documents


def test_stages_one_after_the_other(spark, sf):
    docs = documents(spark, sf)
    columns = docs.columns
    before = [(r["doc_id"], r["text"]) for r in docs.collect()]
    steps = dict(pipeline.STAGES)

    kept = steps["quality_rules"](spark, docs, sf).cache()
    assert kept.columns == columns
    good = [(r[0], t) for r, (_, t) in zip(brute.quality(before), before, strict=True) if r[-1]]
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(good)

    lined = steps["line_dedup"](spark, kept, sf).cache()
    assert lined.columns == columns
    texts = [(r["doc_id"], r["text"], r["n_chars"]) for r in lined.collect()]
    expected = {(d, h) for d, _, _, h in brute.line_dedup(good) if h != brute.sha(b"")}
    assert {(d, brute.sha(t.encode())) for d, t, _ in texts} == expected
    assert all(n == len(t) for _, t, n in texts)

    single = steps["simhash_near_dedup"](spark, lined, sf).cache()
    assert single.columns == columns
    stay = {d for d, _, c in brute.simhash_groups([(d, t) for d, t, _ in texts]) if d == c}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(stay)

    mix = steps["source_mix"](spark, single, sf).cache()
    assert mix.columns == columns
    assert {r["doc_id"] for r in mix.collect()} == stay

    packed = steps["best_fit_packing"](spark, mix, sf).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    total = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mix.collect())
    assert sum(r["length"] for r in packed) == total
    assert len({r["sequence_id"] for r in packed}) >= -(-total // 2048)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_each_stage_takes_messy_and_empty_tables(spark, docs, none, name):
    stage = dict(pipeline.STAGES)[name]
    got = stage(spark, docs, "")
    assert name == "best_fit_packing" or got.columns == docs.columns
    assert got.count() > 0
    assert stage(spark, none, "").count() == 0


def test_run_is_the_stages(spark, sf):
    assert pipeline.run(spark, sf).count() > 0
    assert pipeline.ORACLE_SQL is None
