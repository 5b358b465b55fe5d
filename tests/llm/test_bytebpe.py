"""Byte-level BPE against the library's own encoder, and the round trip."""

import struct
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from llm import brute

from thermofleet.llm import bytebpe, queries

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    with open(queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def plain(ranks):
    encoding: tiktoken.Encoding = bytebpe._encoding(ranks, PATTERN)

    def encode(text):
        ids = encoding.encode_ordinary(text or "")
        return struct.pack(f"<{len(ids)}I", *ids)

    return encode


ODD = ["\x1c x\x85y  z", "it's I'll 'sabc ''s  \t\n end ", "٣٤ ½x²", "𝔘𝔫𝔦 👩‍👩‍👧 é", "!'s?' 's", "<|endoftext|>", "Ω" * 3000, "ab" * 200_000, " " * 5000 + "x"]


def test_equals_the_library(docs, pairs, none, ranks, plain):
    got = bytebpe.decoded(bytebpe.encoded(docs, ranks, PATTERN), ranks).collect()
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == Counter((d, plain(t), (t or "").encode()) for d, t in pairs)
    empty = bytebpe.decoded(bytebpe.encoded(none, ranks, PATTERN), ranks)
    assert empty.columns == ["doc_id", "ids", "decoded"] and empty.count() == 0


@pytest.mark.parametrize("chunk_bytes", [1, 2_000])
def test_odd_texts_in_many_chunks(spark, ranks, plain, chunk_bytes, monkeypatch):
    monkeypatch.setattr(bytebpe, "MOST_BUCKETS", 8)
    monkeypatch.setattr(bytebpe, "LONG_TEXT", 1_000)
    rows = [(k, t) for k, t in enumerate(ODD * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = bytebpe.encoded(df, ranks, PATTERN, chunk_bytes, decode=True).collect()
    assert {r["doc_id"]: (bytes(r["ids"]), bytes(r["decoded"])) for r in got} == {k: (plain(t), t.encode()) for k, t in rows}


def test_decoding_by_itself(spark, ranks, plain, monkeypatch):
    monkeypatch.setattr(bytebpe, "BLOCK", 7)
    df = spark.createDataFrame([(1, bytearray(plain("Ein Wort und noch eines, süß")), "a"), (2, None, "b")], "doc_id long, `my.ids` binary, decoded string")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bytebpe.decoded(df, ranks, "my.ids").collect()}
    assert got == {1: "Ein Wort und noch eines, süß".encode(), 2: b""}


def test_positions_move_no_more(docs, ranks):
    """The stored chunks are not shuffled when they meet the answers."""
    plan = bytebpe.encoded(docs, ranks, PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "places" in plan
    assert not any("places" in line for line in plan.splitlines() if "Exchange" in line)


def test_query(spark, sf, sf_pairs, plain):
    got = queries.QUERIES["op13_byte_bpe"](spark, sf).collect()
    expected = [(d, len(plain(t)) // 4, brute.sha(plain(t)), brute.sha((t or "").encode())) for d, t in sf_pairs]
    assert Counter(tuple(r) for r in got) == Counter(expected)
