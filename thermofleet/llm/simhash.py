"""SimHash near-duplicate groups with pigeonring filtering.

A fingerprint's 64 bits form a ring of five segments. If two fingerprints differ in at most four bits, some segment starts
a chain whose first l segments differ in at most 4l/5 bits together, for every l: the first segment is equal and the
second differs in one bit at most. So each fingerprint is indexed under (segment, next segment) and looks up its own pair
and those with one more bit in the second; longer chains are checked on the found pairs, then the whole distance.

Only distinct fingerprints are linked, so copies cost one row. A group of many close fingerprints would still give all its
pairs: each index key first ties its members to a few pivots, the components of those links are labelled, and only pairs
of different labels are looked up afterwards. No link between components is lost, and none inside one is needed.

A null or empty text has fingerprint zero, linked like any other; a row without doc_id takes part but gives no component
id of its own (its group's smallest id, or null). Repeated rows share their group. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from thermofleet.llm.components import connected
from thermofleet.llm.tables import stored

SHINGLE = 4
MAX_BITS = 4
SEED = 42
WIDTHS = (13, 13, 13, 13, 12)  # bits per segment of the ring
PIVOTS = 3


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of the text's word shingles, each with its repeats."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at:at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fp, the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((t or "").encode(), size) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(np.array(found, np.uint64).view(np.int64))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _segment(fp: Column, k: int) -> Column:
    at = sum(WIDTHS[: k % 5])
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << WIDTHS[k % 5]) - 1))


def _key(k: int, first: Column, second: Column) -> Column:
    return (F.lit(k << 32) + F.shiftleft(first, 13) + second).alias("key")


def index_keys(fp: Column) -> Column:
    return F.array(*[_key(k, _segment(fp, k), _segment(fp, k + 1)) for k in range(5)])


def probe_keys(fp: Column) -> Column:
    """The index keys, and those with one bit more in the second segment: of two that differ there, one has it zero."""
    every = []
    for k in range(5):
        first, second = _segment(fp, k), _segment(fp, k + 1)
        every.append(_key(k, first, second))
        every += [F.when(second.bitwiseAND(F.lit(1 << b)) == 0, _key(k, first, second + F.lit(1 << b))) for b in range(WIDTHS[(k + 1) % 5])]
    return F.array_compact(F.array(*every))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def chain_holds(a: Column, b: Column, key: Column) -> Column:
    """The chain from the key's segment keeps to its budget at every length (lengths one and two hold by the key)."""
    ring = [F.bit_count(_segment(a, k).bitwiseXOR(_segment(b, k))) for k in range(5)]
    start, checks = F.shiftright(key, 32), None
    for k in range(5):
        three = ring[k] + ring[(k + 1) % 5] + ring[(k + 2) % 5]
        four = three + ring[(k + 3) % 5]
        ok = (three <= 3 * MAX_BITS // 5) & (four <= 4 * MAX_BITS // 5)
        checks = F.when(start == k, ok) if checks is None else checks.when(start == k, ok)
    return checks


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that give the components of all links at four bits or fewer.

    Spark takes an exploded table for as small as the table before, and would send a side of millions of keys through the driver
    as long as the fingerprints are few megabytes; the joins on keys are sort-merge joins whatever the sizes.
    """
    index = fps.select("fp", F.explode(index_keys(F.col("fp"))).alias("key"))
    pivots = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.min_by("fp", F.xxhash64("fp", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
    pivots = stored(pivots.where("n > 1").select("key", F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("pivots")), "pivots")
    near = index.join(pivots.hint("merge"), "key").select("fp", F.explode("pivots").alias("v")).where((F.col("fp") != F.col("v")) & (distance(F.col("fp"), F.col("v")) <= MAX_BITS))
    first = stored(near.select(F.col("fp").alias("u"), "v").distinct(), "pivot-links")

    labels = connected(first)
    named = fps.join(labels, fps["fp"] == labels["node"], "left").select("fp", F.coalesce("root", "fp").alias("label"))
    named = stored(named, "named")
    index = named.select("fp", "label", F.explode(index_keys(F.col("fp"))).alias("key"))
    spans = stored(index.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "key-labels")
    asked = named.select("fp", "label", F.explode(probe_keys(F.col("fp"))).alias("key")).join(spans.hint("merge"), "key")
    asked = asked.where((F.col("lo") != F.col("label")) | (F.col("hi") != F.col("label")))
    asked = stored(asked.select("key", F.col("fp").alias("u"), F.col("label").alias("lu")), "probes")
    pairs = asked.hint("merge").join(index.select("key", F.col("fp").alias("v"), F.col("label").alias("lv")), "key")
    pairs = pairs.where((F.col("lu") != F.col("lv")) & chain_holds(F.col("u"), F.col("v"), F.col("key")) & (distance(F.col("u"), F.col("v")) <= MAX_BITS))
    return first.unionByName(pairs.select("u", "v").distinct())


def _rooted(own: DataFrame, least: Column) -> DataFrame:
    """fp, least (an aggregate of its rows) and root (a fingerprint that names its group) of every distinct fingerprint."""
    fps = stored(own.groupBy("fp").agg(least.alias("least")), "distinct-fingerprints")
    roots = connected(links(fps.select("fp")))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return stored(rooted, "rooted")


def groups(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links) for every row."""
    own = stored(fingerprints(docs, size).select("doc_id", "fp"), "fingerprints")
    rooted = _rooted(own, F.min("doc_id"))
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    named = stored(rooted.join(least, "root").select("fp", "component_id"), "named-fingerprints")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of each group, with its own columns: that of the smallest id (of rows without id, if no row has one), then of the
    smallest text hash. Neither null ids nor one id with several texts tie groups to each other."""
    own = stored(fingerprints(docs, size), "fingerprints")
    rooted = _rooted(own, F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")))
    stay = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("_stay"), F.col("least.text_key").alias("_stay_key"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), _text_key().alias("_key"), F.struct("*").alias("_doc"))
    kept = rows.join(stay, (F.col("_key") == F.col("_stay_key")) & F.col("_id").eqNullSafe(F.col("_stay")))
    return kept.dropDuplicates(["_id", "_key"]).select("_doc.*")
