"""Phrase collocations against their plain version, also with fingerprints so narrow that most of them collide."""

import random
from collections import Counter

import pytest
from llm import brute

from thermofleet.llm import phrases


def messy(seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "And", "new", "york", "city", "süß", "a'b", "-", "x y", "\x1cz"]
    rows = []
    for k in range(120):
        parts = [rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) + rng.choice(words) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "en", "en", "", None, "und", "de"]), "".join(parts)))
    return rows + [("en", None), (None, None), ("de", ""), ("en", "the new york " * 3000), ("e", "n the of"), ("en", "\n\n.,")] * 2


def same(got, expected):
    assert Counter(tuple(r) for r in got.collect()) == Counter(expected)


@pytest.fixture(scope="module")
def texts():
    return messy()


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame([(k, t, lang, "x") for k, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string, phrase string").repartition(3).cache()


def test_equals_plain_version(table, texts, none):
    same(phrases.collocations(table), brute.phrases(texts))
    assert phrases.collocations(none).count() == 0


def test_collisions_and_many_chunks(table, texts):
    same(phrases.collocations(table, chunk_bytes=500, bits=9, full_bits=5), brute.phrases(texts))


def test_longer_phrases_all_ranks(table, texts):
    same(phrases.collocations(table, max_words=4, min_count=3, inside_percent=70, limit=None), brute.phrases(texts, 4, 3, 70, None))
    same(phrases.collocations(table, max_words=2, min_count=2, limit=7), brute.phrases(texts, 2, 2, limit=7))


def test_messy_documents(docs, rows):
    same(phrases.collocations(docs, min_count=4), brute.phrases([(lang, t) for _, t, lang, _ in rows], least=4))


def test_exact_beyond_64_bits(spark):
    a, left, right = 3 * 10**12 + 1, 7 * 10**12 + 3, 9 * 10**12 + 7
    df = spark.createDataFrame([("en", "p q", 2, a), ("en", "p", 1, left), ("en", "q", 1, right)], "lang string, phrase string, words int, n long")
    assert [tuple(r) for r in phrases.scored(df).collect()] == [("en", "p q", a, left, right, 10**6 * a * a // (left * right))]


def test_colliding_words_are_told_apart(monkeypatch):
    from thermofleet.llm import hashing

    monkeypatch.setattr(phrases, "word_hashes", lambda *a: hashing.word_hashes(*a) % hashing.U(3))
    grams = phrases._Grams([0], [b"one two three four two one"], 2)
    names = [grams.data[s:e].tobytes() for s, e in zip(grams.starts, grams.ends, strict=True)]
    numbers = grams.words().tolist()
    assert len(set(zip(names, numbers, strict=True))) == len(set(names)) == len(set(numbers))
