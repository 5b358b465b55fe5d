"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots; bytes and rows are summed per slot; a versioned map says which shard a
slot lies in. Only the map (one row per slot, whatever the data) is edited when shards are balanced or added, so a
record's slot never changes. Everything is DataFrame expressions; the largest thing in one task is the slot table.

A record's slot is a hash of its id and its text. Rows that repeat both are dealt over the slots by a number of their own, so
neither a null id nor a group of copies fills a slot. Nulls: a null text has no bytes, a null id hashes like any value. Repeated
rows each get a place of their own; ties in a slot's order are equal rows. A very long text is one record. An empty table gives
an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from thermofleet.llm.ranks import with_salt
from thermofleet.llm.tables import stored

SLOTS = 8_192  # virtual slots, fixed for the life of a data set
ROW_BYTES = 8  # what the id of a record adds to the bytes of its text


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One stored row per record: doc_id, size, text_crc32 and its virtual slot. The text goes no further than this."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_text"), F.monotonically_increasing_id().alias("_uid"),
    ), "shard-texts")
    slot = F.pmod(F.xxhash64("doc_id", "_text", "_salt"), F.lit(slots)).cast("int")
    return stored(with_salt(rows, ["doc_id", "_text"]).select("doc_id", "size", "text_crc32", slot.alias("virtual_slot")), "shard-rows")


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows per occupied slot, summed before the shuffle."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def _deal(slots: DataFrame, loads: Column) -> DataFrame:
    """Give each slot (virtual_slot, bytes), largest first, to the shard with the least bytes so far.

    One fold over the slot table: it has at most as many rows as there are virtual slots.
    """
    order = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("b"), F.col("virtual_slot").alias("v")))),
        lambda s: F.struct((-s["b"]).alias("bytes"), s["v"].alias("virtual_slot")),
    )
    start = F.struct(
        F.col("l").alias("loads"), F.lit(0).alias("at"),
        F.expr("CAST(array() AS array<struct<virtual_slot:int,shard:int>>)").alias("map"),
    )

    def give(acc: Column, s: Column) -> Column:
        at = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(acc["loads"], lambda x, i: F.when(i == at, x + s["bytes"]).otherwise(x)).alias("loads"), at.alias("at"),
            F.concat(acc["map"], F.array(F.struct(s["virtual_slot"].alias("virtual_slot"), at.alias("shard")))).alias("map"),
        )

    return slots.agg(order.alias("o"), F.first(loads.cast("array<bigint>")).alias("l")).select(F.inline(F.aggregate("o", start, give, lambda acc: acc["map"])))


def first_map(sizes: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: every slot, empty ones too, dealt by bytes."""
    every = sizes.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot")).join(sizes, "virtual_slot", "left")
    return _deal(every.select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes")), F.array_repeat(F.lit(0), shards)).withColumn("version", F.lit(0))


def _edited(slot_map: DataFrame, moved: DataFrame) -> DataFrame:
    """The next version: the same map but for the moved slots."""
    return slot_map.join(moved.select("virtual_slot", F.col("shard").alias("to")), "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("to", "shard").alias("shard"), (F.col("version") + 1).alias("version")
    )


def _surplus(slot_map: DataFrame, sizes: DataFrame, allowed: Column) -> DataFrame:
    """Slots (largest first) that each shard can hand on while it stays at or above `allowed` bytes."""
    held = slot_map.join(sizes, "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    w = Window.partitionBy("shard")
    held = held.withColumn("load", F.sum("bytes").over(w)).withColumn("total", F.sum("bytes").over(Window.partitionBy("version")))
    taken = F.sum("bytes").over(w.orderBy(F.desc("bytes"), "virtual_slot"))
    return held.withColumn("taken", taken).where((F.col("bytes") > 0) & (F.col("load") - F.col("taken") >= allowed))


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version after sizes have changed: full shards hand slots to the emptiest ones, others stay."""
    free = _surplus(slot_map, sizes, F.col("total") / shards)
    stay = slot_map.join(free.select("virtual_slot"), "virtual_slot", "left_anti").join(sizes, "virtual_slot", "left")
    held = {r["shard"]: r["b"] for r in stay.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}  # one row per shard
    return _edited(slot_map, _deal(free.select("virtual_slot", "bytes"), F.array(*[F.lit(held.get(k) or 0) for k in range(shards)])))


def grown(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version with shard number `shards` added: slots move into the new shard only."""
    moved = _surplus(slot_map, sizes, F.col("total") / (shards + 1)).withColumn("shard", F.lit(shards))
    return _edited(slot_map, moved)


def placed(rows: DataFrame, sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add shard and the row's gapless place in it: rows before its virtual slot, then its rank within the slot.

    Ranks are taken per virtual slot, so no task holds a shard. The map has at most one row per slot: broadcast.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = slot_map.join(sizes, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.join(F.broadcast(base), "virtual_slot").withColumn("slot", F.col("base") + rank - 1).drop("base")


def sharded(docs: DataFrame, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """Every record with its shard and place; the map is stored as version 0."""
    rows = sized(docs, slots)
    sizes = stored(slot_sizes(rows), "slot-sizes")
    slot_map = stored(first_map(sizes, shards, slots), "slot-map")
    return placed(rows, sizes, slot_map)
