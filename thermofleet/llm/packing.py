"""Best-fit-decreasing packing of tokenised documents into sequences.

Lengths are whole numbers up to the sequence size, so best-fit decreasing can be planned on counts: pieces of one length
are placed together, each time into the open sequences with the least room that still fits, found by a segment tree over
the possible remaining capacities. The plan only sees one count per length (2,048 numbers at most, whatever the corpus)
and is the exact global best-fit-decreasing packing. Tasks then number the pieces of each length and read their place
off the plan. Pieces of one length are numbered in hash buckets, so a length that many pieces share is spread.

A null text is empty and gives one piece that holds only the end id. Repeated rows are packed like others. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from thermofleet.llm.tables import stored

SEQUENCE = 2_048
CACHE_WORDS = 400_000  # words a worker remembers: the first it meets, among which the frequent ones are
BUCKET_ROWS = 1_024  # pieces of one length that are numbered in one group, about

BLOCK_WORDS = 512  # words that are encoded as one text

PUNCTUATION = b"!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"

_TOKENIZERS: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The tokenizer, which of its ids end a word, its word cache and the type it keeps ids in, once per Python worker."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(tokenizer.get_vocab_size(), bool)
        ends[[k for token, k in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        _TOKENIZERS[path] = (tokenizer, ends, {}, np.dtype("<u2" if len(ends) <= 1 << 16 else "<u4"))
    return _TOKENIZERS[path]


def _parts(word: bytes) -> list[bytes]:
    """A word as parts that the tokenizer treats apart and that recur more often: letters, then a run of punctuation.

    Words with `<` may hold a special token and stay whole.
    """
    if b"<" in word:
        return [word]
    if word.isascii():
        word = word.lower()
    core = word.rstrip(PUNCTUATION)
    if core and core != word and core.decode().isalpha():
        return [core, word[len(core):]]
    return [word]


def _encoded(words: list[bytes], tokenizer, ends: np.ndarray, kind: np.dtype) -> Iterator[tuple[bytes, bytes]]:
    """Each word with its ids as bytes. Words of letters are encoded many at a time and parted where an id ends a word."""
    alone, letters = [], []
    for w in words:
        (letters if w.decode().isalpha() else alone).append(w)
    blocks = [letters[k:k + BLOCK_WORDS] for k in range(0, len(letters), BLOCK_WORDS)]
    for block, e in zip(blocks, tokenizer.encode_batch_fast([b" ".join(b).decode() for b in blocks], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, kind)
        cuts = kind.itemsize * (np.flatnonzero(ends[ids]) + 1)
        if len(cuts) != len(block):  # a letter that becomes several characters in lower case
            alone += block
            continue
        data, at = ids.tobytes(), 0
        for word, cut in zip(block, cuts.tolist(), strict=True):
            yield word, data[at:cut]
            at = cut
    for k in range(0, len(alone), 5_000):
        some = alone[k:k + 5_000]
        for word, e in zip(some, tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
            yield word, np.array(e.ids, kind).tobytes()


def token_bytes(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers. The tokenizer drops white space, so words are independent."""
    tokenizer, ends, known, kind = _tokenizer(path)
    split = [t.split() for t in texts]
    parts = {w: _parts(w) for w in set(filterfalse(known.__contains__, chain.from_iterable(split)))}
    fresh = dict(_encoded(list({p for ps in parts.values() for p in ps} - known.keys()), tokenizer, ends, kind))
    full = len(known) > CACHE_WORDS
    known.update(fresh)
    for w, ps in parts.items():
        fresh[w] = known[ps[0]] if len(ps) == 1 else known[ps[0]] + known[ps[1]]
    known.update(fresh)
    out = [np.frombuffer(b"".join(map(known.__getitem__, ws)), kind).astype("<u4").tobytes() for ws in split]
    if full:
        for w in fresh:
            del known[w]
    return out


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids. The end id 0 closes every document."""
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    types = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(types + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = [t or b"" for t in some.column(1).cast(pa.binary()).to_pylist()]
                out: list[list] = [[] for _ in schema]
                for doc, ids in zip(some.column(0).to_pylist(), token_bytes(texts, tokenizer_path), strict=True):
                    ids += b"\0\0\0\0"
                    for k, a in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[a:a + 4 * size]
                        row = [doc, k, a // 4, len(own) // 4, zlib.crc32(own)] + ([np.frombuffer(own, "<i4")] if with_ids else [])
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, fields)


class Capacities:
    """Segment tree over remaining capacities 0..size: how many open sequences have each."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        k = capacity + self.leaves
        while k:
            self.sums[k] += n
            k >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that an open sequence has."""
        k = least + self.leaves
        if self.sums[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.sums[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.sums[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Rules (length, first number, per sequence, first sequence, offset) for the pieces of each length in their order.

    Longest first. Pieces of one length fill the tightest open sequences one after the other, each as far as it goes: a
    sequence that has just taken one has less room than its former equals, so best fit stays with it.
    """
    open_: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by capacity: ranges (first sequence, number of them)
    tree, rules, made = Capacities(size), [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_[capacity].append((first, n))
            tree.add(capacity, n)

    for length in sorted(counts, reverse=True):
        number, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = size, size // length
                first, n = made, -(-left // per)
                made += n
            else:
                per = room // length
                first, n = open_[room].pop()
                tree.add(room, -n)
            used = min(n, -(-left // per))
            rules.append((length, number, per, first, size - room))
            placed = min(left, used * per)
            whole, rest = divmod(placed, per)
            put(room - per * length, first, whole)
            if rest:
                put(room - rest * length, first + whole, 1)
            if used < n:
                put(room, first + used, n - used)
            number, left = number + placed, left - placed
    return rules


def packed(parts: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32 and more). `parts` must be stored, with a
    number `_uid` for each piece."""
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    buckets = max(1, -(-max(counts.values(), default=0) // BUCKET_ROWS))
    # a number per stored piece, so that neither a null id nor copies of a document fill a bucket
    own = parts.withColumn("_bucket", F.pmod(F.xxhash64("_uid"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("length").alias("_l"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")
    )
    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_uid")) - 1
    numbered = own.withColumn("_rank", rank).join(base, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    numbered = numbered.withColumn("_number", F.col("_base") + F.col("_rank")).drop("_bucket", "_rank", "_l", "_b", "_base", "_uid")
    # the plan's size depends on the sequence size alone, so it may go to every task
    plan = np.array(sorted(best_fit_plan(counts, size)) or np.zeros((0, 5)), np.int64)
    shared = spark.sparkContext.broadcast(plan)
    fields = [f for f in numbered.schema.fields if f.name != "_number"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value
        keys = rules[:, 0] << 44 | rules[:, 1]
        for batch in batches:
            table = pa.Table.from_batches([batch])
            length, number = (table.column(c).to_numpy() for c in ("length", "_number"))
            rule = rules[np.searchsorted(keys, length << 44 | number, "right") - 1]
            turn, within = np.divmod(number - rule[:, 1], rule[:, 2])
            table = table.drop_columns(["_number"])
            table = table.append_column("sequence_id", pa.array(rule[:, 3] + turn)).append_column("offset", pa.array(rule[:, 4] + within * length))
            yield from table.to_batches()

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return numbered.mapInArrow(place, out)


def packed_documents(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    numbered = pieces(docs, tokenizer_path, size, with_ids).withColumn("_uid", F.monotonically_increasing_id())
    return packed(stored(numbered, "pieces"), size)
