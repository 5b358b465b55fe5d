"""Byte-level BPE encoding and decoding of whole tables: each distinct pre-token is encoded once.

Documents are gathered into chunks. A chunk splits its texts into pre-tokens, keeps their positions as numbers of its distinct
words, and sends every distinct word, as one of a compact row per hash part, through the global shuffle. The task of a part
sees a word once per chunk, encodes the distinct ones once, and returns their ids to each chunk that asked; the ids meet the
chunk's positions and give every document its ids. Chunks lie in a table that is bucketed by chunk, so only the answers move
when the two meet. Decoding joins ids with the table of token bytes, which the size of the vocabulary bounds: every task has it.

Numbers of words: within a part by falling frequency, and the part in the lowest digits; frequent words so have small numbers
and positions compress to about a byte and a half.

Null texts count as empty: no ids, no bytes. A null doc_id is kept. Repeated rows and rows of one doc_id are documents of their
own. A very long text is a chunk of its own; a very long pre-token is one word like any other. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from thermofleet.llm.hashing import ranges
from thermofleet.session import scratch_path

CHUNK_BYTES = 16 << 20  # text of a chunk, about
PART_BYTES = 8 << 20  # distinct words of a part over all chunks, about
WORD_SHARE = 0.2  # bytes of the chunks' distinct words per byte of text, for the number of parts
LEAST_PARTS, LEAST_BUCKETS, MOST_BUCKETS = 32, 32, 1 << 16  # Spark takes no more than 100,000 buckets; one holds any number of chunks
LONG_TEXT = 4 << 20  # characters from which a text is not split at once
BLOCK = 1 << 20  # ids decoded at once

CHUNK = "chunk long, doc_ids array<long>, counts array<int>, places binary, words array<struct<part:int,payload:binary>>"


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding(hashlib.sha256(ranks).hexdigest(), pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(ranks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes in one array, and first place and length by id."""
    table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, ranks.splitlines())}
    size = np.zeros(max(table, default=-1) + 1, np.int64)
    for token, value in table.items():
        size[token] = len(value)
    return np.frombuffer(b"".join(table[k] for k in sorted(table)), np.uint8), np.cumsum(size) - size, size


def _squeeze(*columns: np.ndarray) -> bytes:
    """Arrays of whole numbers, each byte of their values apart, compressed; each with its own length."""
    out = []
    for c in columns:
        c = np.ascontiguousarray(c, "<u4")
        body = pa.Codec("zstd", 3).compress(c.view(np.uint8).reshape(len(c), 4).T.tobytes(), asbytes=True)
        out.append(np.array([len(c), len(body)], "<u8").tobytes() + body)
    return b"".join(out)


def _spread(payload: bytes) -> Iterator[np.ndarray]:
    at = 0
    while at < len(payload):
        n, size = np.frombuffer(payload, "<u8", 2, at).tolist()
        planes = pa.Codec("zstd").decompress(payload[at + 16:at + 16 + size], 4 * n, asbytes=True)
        yield np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).reshape(-1).view("<u4")
        at += 16 + size


def _packed_words(words: list[bytes]) -> bytes:
    blob = pa.Codec("zstd", 3).compress(b"".join(words), asbytes=True)
    return np.array([len(blob)], "<u8").tobytes() + blob + _squeeze(np.fromiter(map(len, words), "<u4", len(words)))


def _unpacked_words(payload: bytes) -> list[bytes]:
    (size,) = np.frombuffer(payload, "<u8", 1).tolist()
    (lengths,) = _spread(payload[8 + size:])
    stops = np.cumsum(lengths, dtype=np.int64)
    blob = pa.Codec("zstd").decompress(payload[8:8 + size], int(stops[-1]), asbytes=True)
    return [blob[a:b] for a, b in zip((stops - lengths).tolist(), stops.tolist(), strict=True)]


class _Numbers(dict):
    """Numbers words in the order they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _chunk_row(ids: list, counts: list[int], numbers: _Numbers, places: array, parts: int) -> pa.RecordBatch:
    at = np.frombuffer(places, np.int32)
    words = [w.encode() for w in numbers]
    part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
    order = np.lexsort((-np.bincount(at, minlength=len(words)), part))
    sizes = np.bincount(part, minlength=parts)
    within = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    final = np.empty(len(words), np.int64)
    final[order] = within * parts + part[order]
    asked, begin = [], 0
    for p in np.flatnonzero(sizes).tolist():
        own = order[begin:begin + sizes[p]].tolist()
        asked.append({"part": p, "payload": _packed_words([words[k] for k in own])})
        begin += sizes[p]
    row = {"chunk": [0], "doc_ids": [ids], "counts": [counts], "places": [_squeeze(final[at])], "words": [asked]}
    kinds = pa.schema([
        ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("places", pa.binary()),
        ("words", pa.list_(pa.struct([("part", pa.int32()), ("payload", pa.binary())]))),
    ])
    return pa.RecordBatch.from_pydict(row, schema=kinds)


def _chunks(docs: DataFrame, pattern: str, parts: int, chunk_bytes: int) -> DataFrame:
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, number = regex.compile(pattern), TaskContext.get().partitionId() << 32
        ids, counts, numbers, places, size = [], [], _Numbers(), array("i"), 0

        def row() -> pa.RecordBatch:
            made = _chunk_row(ids, counts, numbers, places, parts)
            return made.set_column(0, "chunk", pa.array([number], pa.int64()))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text, before = text.as_py() or "", len(places)
                if len(text) < LONG_TEXT:
                    places.extend(map(numbers.__getitem__, split.findall(text)))
                else:
                    places.extend(numbers[m.group()] for m in split.finditer(text))
                ids.append(doc)
                counts.append(len(places) - before)
                size += len(text)
                if size >= chunk_bytes:
                    yield row()
                    number, ids, counts, numbers, places, size = number + 1, [], [], _Numbers(), array("i"), 0
        if ids:
            yield row()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(gather, CHUNK)


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """Stored in the shared folder, dealt by the key: what is joined with it by the key moves, the table does not."""
    spark, name = rows.sparkSession, f"chunks_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, key).option("path", scratch_path(spark, name)).option("compression", "none").saveAsTable(name)
    return spark.table(name)


def _bytes_of(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """The ids joined with the token-byte table, block by block."""
    (blob, first, size), text = table, []
    for at in range(0, len(ids), BLOCK):
        some = ids[at:at + BLOCK]
        text.append(blob[ranges(first[some], first[some] + size[some] - 1)].tobytes())
    return b"".join(text)


def encoded(docs: DataFrame, ranks: bytes, pattern: str, chunk_bytes: int = CHUNK_BYTES, decode: bool = False) -> DataFrame:
    """Per row: doc_id and ids, a binary of little-endian unsigned 32-bit ids; with `decode` also decoded, the bytes that the ids
    stand for, joined where the ids are put together. `ranks` is the content of a rank file."""
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << max(LEAST_PARTS - 1, int(total * WORD_SHARE / PART_BYTES)).bit_length()
    buckets = min(max(LEAST_BUCKETS, total // (4 * chunk_bytes)), MOST_BUCKETS)
    chunks = _bucketed(_chunks(docs, pattern, parts, chunk_bytes), "chunk", buckets)
    vocabulary = spark.sparkContext.broadcast(ranks)  # bounded: one vocabulary file

    def encode(table: pa.Table) -> pa.Table:
        encode_word, known, answers = _encoding(vocabulary.value, pattern)._encode_single_piece, {}, []
        for payload in table.column("payload"):
            own = []
            for word in _unpacked_words(payload.as_py()):
                if (ids := known.get(word)) is None:
                    ids = known[word] = encode_word(word)
                own.append(ids)
            flat = np.fromiter((i for ids in own for i in ids), "<u4")
            answers.append(_squeeze(np.fromiter(map(len, own), "<u4", len(own)), flat))
        return table.select(["chunk", "part"]).append_column("ids", pa.array(answers, pa.binary()))

    words = chunks.select("chunk", F.explode("words").alias("w")).select("chunk", "w.part", "w.payload")
    answers = words.groupBy("part").applyInArrow(encode, "chunk long, part int, ids binary")

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        out_ids, out_docs, out_bytes = [], [], []
        tokens = _token_bytes(vocabulary.value) if decode else None
        found = dict(zip(right.column("part").to_pylist(), right.column("ids"), strict=True))
        each = {p: tuple(_spread(ids.as_py())) for p, ids in found.items()}
        most = max((len(n) for n, _ in each.values()), default=0)
        first, size = np.zeros((most, parts), np.int64), np.zeros((most, parts), np.int64)
        flat, before = [], 0
        for p, (n, ids) in each.items():
            size[:len(n), p] = n
            first[:len(n), p] = before + np.cumsum(n, dtype=np.int64) - n
            flat.append(ids)
            before += len(ids)
        flat = np.concatenate(flat) if flat else np.zeros(0, "<u4")
        first, size = first.reshape(-1), size.reshape(-1)  # by number: place in the part * parts + part
        for docs_of, counts, payload in zip(left.column("doc_ids"), left.column("counts"), left.column("places"), strict=True):
            (places,) = _spread(payload.as_py())
            at = 0
            for doc, n in zip(docs_of.as_py(), counts.as_py(), strict=True):
                begin, sizes = first[own := places[at:at + n]], size[own]
                ids = flat[ranges(begin, begin + sizes - 1)]
                out_ids.append(ids.tobytes())
                out_docs.append(doc)
                if decode:
                    out_bytes.append(_bytes_of(ids, tokens))
                at += n
        made = {"doc_id": pa.array(out_docs, pa.int64()), "ids": pa.array(out_ids, pa.binary())}
        return pa.table(made | ({"decoded": pa.array(out_bytes, pa.binary())} if decode else {}))

    kept = chunks.select("chunk", "doc_ids", "counts", "places")
    return kept.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(reassemble, "doc_id long, ids binary" + ", decoded binary" * decode)


def decoded(rows: DataFrame, ranks: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`rows` with the bytes that the ids stand for. An id without an entry in the table is an error. Null ids give no bytes."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(ranks)
    kept = [f for f in rows.schema.fields if f.name != out]
    at_ids = [f.name for f in kept].index(ids)
    plain = [f"c{k}" for k in range(len(kept))]  # names without dots on the way through Python

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _token_bytes(vocabulary.value)
        for batch in batches:
            made = [_bytes_of(np.frombuffer(value.as_py() or b"", "<u4"), tokens) for value in batch.column(at_ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*plain, "made"])

    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(plain, kept, strict=True)) + ", made binary"
    renamed = rows.select(*[F.col(f"`{f.name}`").alias(c) for f, c in zip(kept, plain, strict=True)])
    return renamed.mapInArrow(join, schema).toDF(*[f.name for f in kept], out)
