"""Line deduplication over levelled sorted runs of line hashes.

Documents arrive in batches. A batch's line hashes, one row per hash, are merge-joined with the runs: a hash without partner is
new and goes out as a sorted run of level 0, so every hash has its home in exactly one run; a hash that a run holds leaves only
an addition to its counts. As soon as a level holds `fan_in` runs they are merged into one run of the next level, so the number
of runs stays logarithmic. Runs are bucketed by hash: batches move to them, they do not move, and merging two moves nothing.
What a line's key counts for is read from its home and the additions.

A line's key is the line without blanks at its ends and with A-Z lower-cased; keys are compared by two 64-bit hashes.
Documents are rows: two rows of one doc_id count as two documents, and both keep the line if that id is the largest. Rows are
told apart by doc_id and text, equal rows lose the same lines. A null text is one empty line. A null doc_id counts as a document
that is smaller than any other. A very long text is split in the task that reads it. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from thermofleet.llm.tables import BLANKS, bucketed, plain_lower, stored

MIN_CHARS = 40  # shorter keys are never dropped
MIN_DOCS = 5  # documents that must hold a key
BATCHES = 4
FAN_IN = 2
HASH = ["a", "b"]  # of a line's key
MOST_BUCKETS = 1 << 16  # Spark takes no more than 100,000


def line_key(line: Column) -> Column:
    return plain_lower(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def _hash_or_null(line: Column, min_chars: int) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.char_length(bare) >= min_chars, key_hash(plain_lower(bare)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_key() -> list[Column]:
    """What tells rows apart: doc_id and two hashes of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """One row per document and distinct key that is long enough: batch, the row's key, a, b. Rows are dealt into batches by
    their place, so no doc_id and no group of copies fills one; store the result, a second reading may deal otherwise."""
    keys = F.array_distinct(F.array_compact(F.transform(split_lines(F.col("text")), lambda x: _hash_or_null(x, min_chars))))
    dealt = docs.select((F.monotonically_increasing_id() % batches).cast("int").alias("batch"), *row_key(), keys.alias("keys"))
    return dealt.select("batch", "doc_id", "t1", "t2", F.explode("keys").alias("h")).select("batch", "doc_id", "t1", "t2", "h.a", "h.b")


class LineRuns:
    """The runs: per level a list of stored tables (a, b, n_docs, last_doc) sorted by hash within their buckets, no hash in two of
    them; and the additions to the counts of hashes that a run held already."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN):
        # as many buckets as a shuffle has partitions: a batch comes out of its shuffle as it is stored, one file a bucket
        self.buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
        self.fan_in, self.levels, self.additions = fan_in, [[]], []

    def tables(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch (doc_id, a, b) and return its hashes with counts; `fresh` tells those that no run held."""
        own = batch.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        own = own.withColumn("fresh", F.lit(True))
        for run in self.tables():  # no partner in any run means new
            own = own.join(run.select(*HASH, F.lit(True).alias("_held")).hint("merge"), HASH, "left")  # runs stay where they are
            own = own.withColumn("fresh", F.col("fresh") & F.col("_held").isNull()).drop("_held")
        found = bucketed(own, HASH, self.buckets, "line_run")
        self.levels[0].append(found.where("fresh").drop("fresh"))
        self.additions.append(found.where("NOT fresh").drop("fresh"))
        self._compact()
        return found

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.fan_in:
                merged = reduce(self._both, level)
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(bucketed(merged, HASH, self.buckets, "line_run"))

    def _both(self, one: DataFrame, other: DataFrame) -> DataFrame:
        """The rows of two runs, which have no hash in common, merged bucket by bucket."""
        sides = [run.select(*HASH, F.col("n_docs").alias(f"n{k}"), F.col("last_doc").alias(f"d{k}")) for k, run in enumerate((one, other))]
        return sides[0].join(sides[1], HASH, "full").select(*HASH, F.coalesce("n0", "n1").alias("n_docs"), F.coalesce("d0", "d1").alias("last_doc"))

    def repeated(self, min_docs: int) -> DataFrame:
        """Hashes that at least `min_docs` documents hold, with the largest of them: homes and what was added to them."""
        more = reduce(DataFrame.unionByName, self.additions).groupBy(*HASH).agg(F.sum("n_docs").alias("more"), F.max("last_doc").alias("later"))
        found = []
        for run in self.tables():
            both = run.join(more, HASH, "left")
            found.append(both.select(*HASH, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc")).where(F.col("n_docs") >= min_docs))
        return reduce(DataFrame.unionByName, found)


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """Per document that loses lines: its key and the hashes it loses."""
    lines = stored(line_hashes(docs, min_chars, batches), "lines", partition_by="batch")
    runs = LineRuns(docs.sparkSession)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    hot = stored(runs.repeated(min_docs), "hot-lines")
    lost = lines.join(hot.select(*HASH, "last_doc"), HASH).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return lost.groupBy("doc_id", "t1", "t2").agg(F.collect_set(F.struct(*HASH)).alias("lost"))


def without_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """The documents with all their columns, plus n_lines, n_dropped and kept_text (which replace columns of these names)."""
    lost = dropped_keys(docs, min_chars, min_docs, batches).select(*[F.col(c).alias(f"_l{c}") for c in ("doc_id", "t1", "t2")], F.col("lost").alias("_lost"))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    key = [c.alias(f"_k{k}") for k, c in enumerate(row_key())]
    rows = docs.select(F.struct(*own).alias("_doc"), *key, F.coalesce("text", F.lit("")).alias("_text"))
    same = (F.col("_k1") == F.col("_lt1")) & (F.col("_k2") == F.col("_lt2")) & F.col("_k0").eqNullSafe(F.col("_ldoc_id"))
    both = rows.join(lost, same, "left")
    lines = split_lines(F.col("_text"))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("_lost"), _hash_or_null(x, min_chars)), F.lit(False)))
    both = both.withColumn("_kept", F.when(F.col("_lost").isNotNull(), kept))
    return both.select(
        "_doc.*",
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("_lost").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("_kept")).cast("long").alias("n_dropped"),
        F.when(F.col("_lost").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n")).alias("kept_text"),
    )
