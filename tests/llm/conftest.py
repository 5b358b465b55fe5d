import random

import pytest

CLASHES = """length piece start ids spans kept kept_text n_words n_lines n_dropped score base_score size shard slot version virtual_slot block
tokens weight fp u v node root label key chunk part payload h lost batch rank round router page _uid _salt _place _doc _id _key _copy _text _stay""".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def sentence(rng, n):
    return " ".join(rng.choice(["The", "of", "and", "Atouou", "thing.", "ésta", "süß", "edhe,", "onti", "reer", "lystion"]) + rng.choice("abcdefghij") for _ in range(n))


def messy_rows(seed=5):
    """Nulls, empty and very long texts, exact and near copies, shared passages and lines, ties, repeated rows, odd white space."""
    rng = random.Random(seed)
    passage, line = sentence(rng, 60), sentence(rng, 9) + " of a line that many hold"
    texts = [None, "", " ", "\n\n", "one", "A\x1cB C\xa0D", "<|endoftext|> x", "Ünḯ J̌", "a" * 900, "word " * 400, "## ** && || " * 20, sentence(rng, 30).upper()]
    base = [sentence(rng, rng.randint(20, 150)) for _ in range(8)]
    texts += base + base[:3] * 4
    for b in base:
        ws = b.split(" ")
        ws[rng.randrange(len(ws))] = "changed"
        texts.append(" ".join(ws))
    texts += [f"{sentence(rng, 15)} {passage} {sentence(rng, 12)}" for _ in range(6)]
    texts += [f"{sentence(rng, 12)}\n {line.upper() if k % 2 else line}\t\n{sentence(rng, 14)}" for k in range(8)]
    texts.append("\n".join(sentence(rng, 40) for _ in range(120)))
    rows = [(k * 7 % 1009, t, rng.choice(["en", None]), rng.choice(["src0", "src0", "src1", "src2", None])) for k, t in enumerate(texts)]
    rows += [rows[15], rows[15], (None, base[0], "en", "src0"), (None, None, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, len(t or ""), *["x"] * len(CLASHES)) for d, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def pairs(rows):
    return [(d, t) for d, t, _, _ in rows]


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = frame(spark, rows).repartition(3)
    return df.cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def sf_pairs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
