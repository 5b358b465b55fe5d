"""Mixing sources to target weights by temperature.

Source shares of the tokens are raised to an exponent and normalised. The exponent is bisected until the weights have a
target entropy, or until no source is repeated more often than allowed. Weights become token budgets, and a source's budget
becomes blocks: each block is a permutation of all its documents, the last one cut where the budget ends. Every document
of a block gets a place in the whole mix, so that any stretch of the mix holds the sources in their weights.

All numbers of a source come from sums over its rows; the bisection only sees sums over the table of sources. Cuts use
prefix sums over hash buckets, so a source with a third of all rows is spread.

A null source is a source; a null or empty text has no tokens. A source without tokens appears once. Repeated rows are mixed
like others. An empty table gives an empty mix. All columns of the input are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from thermofleet.llm.ranks import with_salt
from thermofleet.llm.tables import n_words, stored

BUCKET_ROWS = 4_096  # rows of a source that one group of the running sum holds, about
STEPS = 12  # rounds of the bisection; each halves three times
MAX_REPEATS = 1.5


def _shares(sources: DataFrame) -> DataFrame:
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    return sources.where("tokens > 0").select("tokens", (F.col("tokens") / F.lit(total)).alias("p"))


def _measure(shares: DataFrame, exponents: list[float], kind: str) -> list[float]:
    """Per exponent: the entropy of the weights, or the most repeats when every document appears at least once."""
    columns = []
    for a in exponents:
        power = F.pow(F.col("p"), F.lit(a))
        if kind == "entropy":
            z = F.sum(power)
            columns.append(F.log(z) - a * F.sum(power * F.log("p")) / z)
        else:
            rate = F.pow(F.col("p"), F.lit(a - 1))
            columns.append(F.max(rate) / F.min(rate))
    return [float(x or 0) for x in shares.agg(*[c.alias(f"m{k}") for k, c in enumerate(columns)]).first()]


def exponent(sources: DataFrame, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS) -> float:
    """The exponent in [0, 1]: of the entropy asked for, else the smallest that keeps every source within `max_repeats`.

    Entropy and repeats both fall as the exponent rises. Each round evaluates seven inner points in one aggregation, which
    is three steps of bisection at once.
    """
    shares = stored(_shares(sources), "shares")
    kind, goal = ("repeats", max_repeats) if target_entropy is None else ("entropy", target_entropy)
    lo, hi = 0.0, 1.0
    if _measure(shares, [lo], kind)[0] <= goal:
        return lo
    for _ in range(STEPS):
        points = [lo + (hi - lo) * k / 8 for k in range(1, 8)]
        above = sum(m > goal for m in _measure(shares, points, kind))
        edges = [lo, *points, hi]
        lo, hi = edges[above], edges[above + 1]
    return hi


def budgets(sources: DataFrame, alpha: float, total: float | None = None) -> DataFrame:
    """source, tokens, n_rows, weight and blocks (budget over tokens).

    Without `total` the budget is the least that shows every document once; then a source is shown (p/p_max)^(alpha-1) times.
    """
    z, most = (float(x or 0) for x in sources.where("tokens > 0").agg(F.sum(F.pow("tokens", F.lit(alpha))), F.max("tokens")).first())
    weight = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(alpha)) / F.lit(z or 1.0)).otherwise(0.0)
    budget = z * most ** (1 - alpha) if total is None else float(total)
    blocks = F.when(F.col("tokens") > 0, weight * budget / F.col("tokens")).otherwise(1.0)
    blocks = F.round(blocks, 9)
    return sources.select("source", "tokens", "n_rows", weight.alias("weight"), blocks.alias("blocks"))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def mixed(docs: DataFrame, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS, total: float | None = None, seed: int = 0, uid: str | None = None) -> DataFrame:
    """Rows (_row_key, source, block, mix_at, tokens): which document is shown in which block, and where in the mix.

    _row_key is a struct of doc_id, the text's hash and the number of the row (column `uid` of `docs`, or one of its own). A row's
    place depends on doc_id and text; rows that repeat both are told apart by their number.
    """
    number = F.col(uid) if uid else F.monotonically_increasing_id()
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), number.cast("long").alias("_uid"),
        F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("tokens"),
    ), "mix-texts")
    key = F.struct(F.col("_id").alias("doc_id"), F.col("_hash").alias("text_hash"), F.col("_uid").alias("uid"))
    rows = stored(with_salt(rows, ["_id", "_hash"]).select(key.alias("_row_key"), "source", "tokens", F.xxhash64("_id", "_hash", "_salt").alias("_place")), "mix-rows")
    sources = stored(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows")), "mix-sources")
    alpha = exponent(sources, target_entropy, max_repeats)
    plan = stored(budgets(sources, alpha, total), "mix-budgets").select(F.col("source").alias("_s"), F.col("tokens").alias("_total"), "n_rows", "weight", "blocks")
    shown = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    shown = shown.withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("blocks") - 1, F.lit(0)).cast("int"))))
    shown = shown.withColumn("u", _uniform(F.lit(seed), F.col("block"), F.col("_place")))
    shown = shown.withColumn("last", F.col("block") + 1 > F.col("blocks"))
    place = ((F.col("block") + F.col("u")) / F.greatest("blocks", F.lit(1e-9))).alias("mix_at")
    whole = shown.where(~F.col("last")).select("_row_key", "source", "weight", "block", place, "tokens")

    part = shown.where("last").withColumn("bucket", F.floor(F.col("u") * F.ceil(F.col("n_rows") / BUCKET_ROWS)))
    part = stored(part.withColumn("budget", F.floor((F.col("blocks") - F.col("block")) * F.col("_total"))), "mix-last-blocks")
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = part.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")).select(
        F.col("source").alias("_s2"), F.col("bucket").alias("_b2"), F.coalesce(F.sum("t").over(w), F.lit(0)).alias("base")
    )
    part = part.join(base, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("bucket") == F.col("_b2")))
    run = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("u", "_row_key").rowsBetween(Window.unboundedPreceding, 0))
    part = part.withColumn("run", F.col("base") + run).where("run <= budget").select("_row_key", "source", "weight", "block", place, "tokens")
    return whole.unionByName(part)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with their own columns, each as often as its source's budget shows it."""
    held = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_uid")), "mix-documents")
    shown = mixed(held.select("_doc.doc_id", "_doc.text", "_doc.source", "_uid"), uid="_uid", **options)
    times = shown.groupBy(F.col("_row_key.uid").alias("_shown")).agg(F.count(F.lit(1)).cast("int").alias("_times"))
    both = held.join(times, F.col("_uid") == F.col("_shown"))
    return both.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select("_doc.*")
