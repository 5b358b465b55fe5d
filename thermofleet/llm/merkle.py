"""Merkle manifest of a table: leaf, path and proof of every row, by a rollup of nested structs.

Rows are numbered within their group in the order of their key; the digits of the number to the base of the fan-out say
where a row stands on each level of its group's tree. A block is FAN_OUT ** LEVELS consecutive nodes. Inside a block the
digits are grouped away one after the other, lowest first: the children of a node become an array of structs inside its own
struct, until a block is one row that holds its tree. The blocks' top nodes are the nodes of the next round, until a group
has one node, its subroot; the subroots, in the order of their groups, are rolled up the same way to the root.

Proofs come down again: a node's path, the hashes left and right of it level by level, meets the node's block as a row of the
same key (one aggregation, no join), a transform walks the nested arrays and lengthens the path, and an explode gives one
row per child. A block is never larger than FAN_OUT ** LEVELS rows, whatever a group holds.

A null field is written `-`. A null group is a group, before all others; null keys come before all others, and rows of one key
are ordered by their leaf hash. Repeated rows are leaves of their own. Texts of any length are read once, for their hash. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from thermofleet.llm.ranks import numbered
from thermofleet.llm.tables import stored

FAN_OUT = 3
LEVELS = 6  # of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_hash(*values: Column) -> Column:
    """Hash of the fields: `-` for null, else byte count, colon, value."""
    written = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in written]))


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def _rolled(nodes: DataFrame, fan_out: int, levels: int) -> DataFrame:
    """Nodes (g, at, n, hash, own) to stored blocks (g, block, n, hash, kids): n is the number of nodes of the group.

    kids: the nodes of the level below as structs (digit, hash, kids), down to (digit, hash, own).
    """
    digits = [F.floor(F.col("at") / fan_out ** k).cast("long") % fan_out for k in range(levels)]
    block = F.floor(F.col("at") / fan_out ** levels).cast("long")
    rows = nodes.select("g", block.alias("block"), "n", *[d.cast("int").alias(f"d{k}") for k, d in enumerate(digits)], "hash", F.col("own").alias("kids"))
    rows = rows.repartition("g", "block")  # serves every grouping below
    for k in range(levels):
        above = [f"d{j}" for j in range(k + 1, levels)]
        own = F.struct(F.col(f"d{k}").alias("digit"), "hash", "kids")
        rows = rows.groupBy("g", "block", "n", *above).agg(F.array_sort(F.collect_list(own)).alias("kids"))
        # a group that is down to one node has come to its top
        several = F.col("n") > fan_out ** k
        rows = rows.withColumn("hash", F.when(several, digest(_joined(F.col("kids.hash")))).otherwise(F.col("kids")[0]["hash"]))
    return stored(rows.select("g", "block", "n", "hash", "kids"), "merkle")


def _rounds(nodes: DataFrame, most: int, fan_out: int, levels: int) -> list[DataFrame]:
    """Blocks of each round, lowest first; the last round has one block per group. `most`: nodes of the largest group."""
    size, tables = fan_out ** levels, []
    while not tables or most > 1:
        tables.append(_rolled(nodes, fan_out, levels))
        nodes = tables[-1].select("g", F.col("block").alias("at"), F.ceil(F.col("n") / size).cast("long").alias("n"), "hash", F.lit(None).cast("string").alias("own"))
        most = -(-most // size)
    return tables


def _down(blocks: DataFrame, paths: DataFrame, fan_out: int, levels: int) -> DataFrame:
    """One row per node of the blocks: g, at, hash, own, path (from the node up), top. `paths`: g, at (the block), path, top."""
    wanted = paths.select("g", F.col("at").alias("block"), "path", "top")
    met = blocks.unionByName(wanted, allowMissingColumns=True).groupBy("g", "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", "top")]
    )

    def walked(kids: Column, k: int, path: Column) -> Column:
        """Structs (place within the block, hash, own, path) of all nodes below `kids`, which stand on level `k`."""
        hashes = F.transform(kids, lambda x: x["hash"])

        def below(kid: Column, at: Column) -> Column:
            step = F.struct(
                _joined(F.slice(hashes, F.lit(1), at)).alias("left"),
                _joined(F.slice(hashes, at + 2, F.greatest(F.size(hashes) - at - 1, F.lit(0)))).alias("right"),
            )
            longer = F.concat(F.when(F.col("n") > fan_out ** k, F.array(step)).otherwise(F.array().cast(STEP)), path)
            if k:
                place = kid["digit"].cast("long") * fan_out ** k
                return F.transform(walked(kid["kids"], k - 1, longer), lambda x: x.withField("place", x["place"] + place))
            return F.array(F.struct(kid["digit"].cast("long").alias("place"), kid["hash"].alias("hash"), kid["kids"].alias("own"), longer.alias("path")))

        return F.flatten(F.transform(kids, below))

    spread = met.select("g", "block", "top", F.explode(walked(F.col("kids"), levels - 1, F.col("path"))).alias("x"))
    return spread.select("g", (F.col("block") * fan_out ** levels + F.col("x.place")).alias("at"), "x.hash", "x.own", "x.path", "top")


def _descended(tables: list[DataFrame], tops: DataFrame, fan_out: int, levels: int) -> DataFrame:
    """Nodes of the lowest round with their paths; `tops`: g, path, top of each group's last node."""
    paths = tops.withColumn("at", F.lit(0).cast("long"))
    for blocks in reversed(tables):
        paths = _down(blocks, paths, fan_out, levels)
    return paths


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the hashes beside its path lead to."""
    return F.aggregate(path, leaf, lambda at, step: digest(F.concat(step["left"], at, step["right"])))


def proof(path: Column) -> Column:
    """Hash of the siblings, level by level, left to right."""
    return digest(_joined(F.transform(path, lambda s: F.concat(s["left"], s["right"]))))


def manifest(
    rows: DataFrame, leaf: Column | None = None, group: str = "source", key: str = "doc_id", carried: Callable[[Column], Column] | None = None,
    fan_out: int = FAN_OUT, levels: int = LEVELS,
) -> DataFrame:
    """One row per row of `rows`: the key, the group, leaf, carried (what the caller wants beside the leaf: a string built from
    the leaf's column), path (array of left and right hashes, bottom up), subroot and root."""
    leaves = rows.select(
        F.col(group).alias("g"), F.col(key).alias("key"), (leaf_hash(*[F.col(c) for c in FIELDS]) if leaf is None else leaf).alias("hash"),
        (F.lit(None) if carried is None else carried).cast("string").alias("carried"),
    )
    placed = stored(numbered(leaves, ["g"], [F.col("key"), F.col("hash")], "at", "n"), "leaves")
    nodes = placed.select("g", "at", "n", "hash", F.struct("key", "carried").alias("own"))
    most = placed.agg(F.max("n")).first()[0] or 0
    trees = _rounds(nodes, most, fan_out, levels)

    subroots = trees[-1].select(F.col("g").alias("name"), "hash")
    ordered = stored(numbered(subroots, [], [F.col("name")], "at", "n"), "subroots")
    above = ordered.select(F.lit("all").alias("g"), "at", "n", "hash", F.struct("name").alias("own"))
    top_trees = _rounds(above, ordered.agg(F.max("n")).first()[0] or 0, fan_out, levels)

    root = top_trees[-1].select("g", F.array().cast(STEP).alias("path"), F.struct(F.col("hash").alias("root")).alias("top"))
    groups = _descended(top_trees, root, fan_out, levels)
    tops = groups.select(F.col("own.name").alias("g"), "path", F.struct(F.col("hash").alias("subroot"), F.col("top.root")).alias("top"))
    found = _descended(trees, tops, fan_out, levels)
    return found.select(F.col("own.key").alias(key), F.col("g").alias(group), F.col("hash").alias("leaf"), F.col("own.carried").alias("carried"), "path", "top.subroot", "top.root")


def tampered_leaf() -> Column:
    """The leaf of a row whose text has lost its line feeds; null for rows that nobody touches (odd checksum or null doc_id)."""
    fields = {c: F.col(c) for c in FIELDS} | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    touched = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(touched, leaf_hash(*fields.values()))


def verified(docs: DataFrame) -> DataFrame:
    """The manifest of documents, with the proof's hash, the root that the possibly tampered row leads to, and whether it fits."""
    rows = manifest(docs, carried=tampered_leaf())
    again = folded(F.coalesce("carried", "leaf"), F.col("path"))
    out = rows.select("doc_id", "source", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
