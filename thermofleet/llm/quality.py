"""Quality rules as a short-circuit cascade.

Each rule is a Boolean expression that rejects a document. On a bounded sample every rule is timed and its rejected share
counted; the cascade then asks the rules in falling order of rejection per cost and stops at the first that rejects. The
order only changes how much work is done, never the verdict, so a differently timed sample gives the same result.

A rule takes what is counted already from the columns that hold it; the words of a text are split once for all rules. Very long
texts are split in the task that reads them. Null and empty texts have no words and are rejected. Equal rows get equal verdicts. An empty table gives an empty result.
Columns of the input with the names of the metrics are not touched: metrics are columns of `measured` alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from thermofleet.llm.tables import BLANKS, UPPER, stored

MIN_WORDS = 10
SYMBOLS = "#*$%&|<>"
REPEAT_WORDS = 5  # words of a repeat window
SAMPLE_ROWS = 2_000  # documents on which costs and rejections are estimated


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _without(chars: str) -> Column:
    return F.char_length(F.translate(_text(), chars, ""))


def word_list() -> Column:
    bare = F.btrim(_text(), F.lit(BLANKS))
    return F.when(F.char_length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def n_symbols() -> Column:
    return F.char_length(_text()) - _without(SYMBOLS)


def word_chars() -> Column:
    return _without(BLANKS)


def window_hashes(words: Column, size: int = REPEAT_WORDS) -> Column:
    """One 64-bit hash for each run of `size` words."""
    return F.when(F.size(words) < size, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))
    )


def repeated_words(hashes: Column, size: int = REPEAT_WORDS) -> Column:
    """Words inside windows whose hash occurs twice. Texts without such windows only pay for one set."""
    paired = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.transform(
        F.array(paired),
        lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"],
        )),
    )[0]
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        twice, start,
        lambda acc, p: F.struct((p + size).alias("end"), (acc["n"] + size - F.greatest(acc["end"] - p, F.lit(0))).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered)


def duplicate_lines() -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(_text(), "\n", -1), lambda x: F.char_length(F.btrim(x, F.lit(BLANKS))) > 0)
    return F.size(lines) - F.size(F.array_distinct(lines))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, although lambdas inside `use` ask for it at every element."""
    return F.transform(F.array(value), use)[0]


@dataclass(frozen=True)
class Facts:
    """What rules look at: taken from the text where they are not given as columns that hold them already."""

    words: Column | None = None
    n_words: Column | None = None
    symbols: Column | None = None
    letters: Column | None = None

    def word_list(self) -> Column:
        return word_list() if self.words is None else self.words

    def count(self) -> Column:
        return F.size(self.word_list()) if self.n_words is None else self.n_words

    def n_symbols(self) -> Column:
        return n_symbols() if self.symbols is None else self.symbols

    def word_chars(self) -> Column:
        return word_chars() if self.letters is None else self.letters


def too_repetitive(facts: Facts) -> Column:
    def verdict(words: Column) -> Column:
        return _bound(window_hashes(words), lambda hashes: 100 * repeated_words(hashes) > 20 * F.size(words))

    return _bound(facts.word_list(), verdict)


# name -> expression that is true where the rule rejects
RULES: dict[str, Callable[[Facts], Column]] = {
    "few_words": lambda f: f.count() < MIN_WORDS,
    "repetitive": too_repetitive,
    "symbols": lambda f: 5 * f.n_symbols() > f.count(),
    "shouting": lambda f: 4 * (F.char_length(_text()) - _without(UPPER)) > f.word_chars(),
    "long_words": lambda f: f.word_chars() > 40 * F.greatest(f.count(), F.lit(1)),
}


def cascade_order(docs: DataFrame, rules: dict[str, Callable[[Facts], Column]] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejected share per second, both taken on a sample of at most about `sample_rows` documents."""
    total = docs.count()
    share = min(1.0, sample_rows / max(total, 1))
    sample = stored(docs.select("text").sample(share, seed=7), "quality-sample")

    def run(rule: Column) -> tuple[float, int]:
        began = time.perf_counter()
        rejected = sample.agg(F.count_if(rule)).first()[0]
        return time.perf_counter() - began, rejected

    run(F.char_length("text") < 0)
    idle = min(run(F.char_length("text") < 0)[0] for _ in range(2))
    found = {}
    for name, rule in rules.items():
        tries = [run(rule(Facts())) for _ in range(2)]
        found[name] = tries[0][1] / max(min(t for t, _ in tries) - idle, 1e-3)
    return sorted(rules, key=lambda name: (-found[name], name))


def rejected_by(order: list[str], rules: dict[str, Callable[[Facts], Column]] = RULES, facts: Facts = Facts()) -> Column:
    """Name of the first rule of the cascade that rejects, null if none does; later rules are not evaluated."""
    verdict = None
    for name in order:
        hit = F.coalesce(rules[name](facts), F.lit(False))
        verdict = F.when(hit, F.lit(name)) if verdict is None else verdict.when(hit, F.lit(name))
    return verdict


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    order = cascade_order(docs)
    # one split for all rules that look at words
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text", word_list().alias("_words"))
    return held.where(rejected_by(order, facts=Facts(words=F.col("_words"))).isNull()).select("_doc.*")


def measured(docs: DataFrame) -> DataFrame:
    """Base metrics of every document, the base verdict and the cascade's.

    The rules that the base metrics already decide are answered from them; the cascade asks only the others.
    """
    order = cascade_order(docs)
    given = Facts(n_words=F.col("n_words"), symbols=F.col("n_symbols"), letters=F.col("word_chars"))
    rest = rejected_by([name for name in order if name not in ("few_words", "repetitive")], facts=given)
    step = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", word_list().alias("_words"))
    step = step.withColumn("_hashes", window_hashes(F.col("_words")))
    step = step.select(
        "doc_id", "text",
        F.size("_words").cast("long").alias("n_words"),
        word_chars().cast("long").alias("word_chars"),
        n_symbols().cast("long").alias("n_symbols"),
        duplicate_lines().cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_hashes")).cast("long").alias("n_repeat_words"),
    )
    step = step.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return step.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(rest.isNull())).drop("text")
