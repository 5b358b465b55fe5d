"""Chunks of documents that ask each other about keys.

Documents are gathered into chunk rows of a few MB. A chunk asks about its distinct 64-bit keys: they are sorted, cut by key
range, and one compact row per chunk and range goes through the shuffle. The task of a range sees each key once per chunk, so
neither a frequent key nor a large group of copies makes it larger, and answers every chunk in the order of its keys. The
chunk then meets its answers and goes on. Chunks and answers are stored in the shared folder.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from thermofleet.llm.tables import stored
from thermofleet.session import scratch_path

CHUNK_BYTES = 4 << 20  # text of a chunk, about; a longer text is a chunk of its own
PART_BYTES = 8 << 20  # keys of a range, about
LEAST_PARTS = 32

ASKED = "part int, chunk long, payload binary"


def _written(batches: list[pa.RecordBatch]) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for batch in batches:
            out.write_batch(batch)
    return sink.getvalue()


def opened(payload: bytes) -> tuple[list, list[bytes]]:
    """The ids and texts (UTF-8, null as empty) of a chunk."""
    table = pa.ipc.open_stream(payload).read_all()
    return table.column(0).to_pylist(), [t or b"" for t in table.column(1).cast(pa.binary()).to_pylist()]


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Stored rows (chunk, text_bytes, payload): neighbouring documents of a partition, compressed."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64()), "text_bytes": pa.array([size], pa.int64()), "payload": pa.array([_written(held)], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                held.append(some)
                size += some.column(1).nbytes
                if size >= chunk_bytes:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = own.mapInArrow(gather, "chunk long, text_bytes long, payload binary")
    path = scratch_path(docs.sparkSession, "chunks")
    # small row groups: a reader holds one at a time
    rows.write.option("parquet.block.size", 16 << 20).option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def parts_for(chunks: DataFrame, key_bytes_per_text_byte: float) -> int:
    """A power of two of key ranges for all of the text."""
    total = chunks.agg(F.sum("text_bytes")).first()[0] or 0
    return 1 << max(LEAST_PARTS - 1, int(total * key_bytes_per_text_byte / PART_BYTES)).bit_length()


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the ranges in sorted keys."""
    if parts == 1:
        return np.array([0, len(keys)])
    shift = np.uint64(64 - (parts.bit_length() - 1))
    return np.concatenate((np.searchsorted(keys >> shift, np.arange(parts, dtype=np.uint64)), [len(keys)]))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as bytes."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpacked(payload: bytes, *types: str) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for t in types]
    n, at, out = len(payload) // sum(sizes), 0, []
    for t, size in zip(types, sizes, strict=True):
        out.append(np.frombuffer(payload, t, n, at))
        at += n * size
    return out


def by_range(chunk: int, parts: int, keys: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Rows (part, chunk, payload) for keys that are sorted, with arrays beside them."""
    at = cuts(keys, parts)
    for part in np.flatnonzero(at[1:] > at[:-1]).tolist():
        a, b = at[part], at[part + 1]
        yield part, chunk, packed(keys[a:b], *[m[a:b] for m in more])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "chunk", "payload"])


def ask(chunks: DataFrame, fn: Callable[[int, list, list[bytes]], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """What each chunk asks: `fn(chunk, ids, texts)` yields rows (part, chunk, payload)."""
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(fn(chunk, *opened(payload.as_py())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return chunks.select("chunk", "payload").mapInArrow(run, ASKED)


def answer(asked: DataFrame, fn: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Stored answers (part, chunk, payload): `fn` gets all payloads of a range and returns one for each."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk", kind="stable")
        return _frame(list(zip(frame["part"], frame["chunk"], fn(list(frame["payload"])), strict=True)))

    return stored(asked.groupBy("part").applyInPandas(run, ASKED), "answers")


def meet(chunks: DataFrame, answers: DataFrame, fn: Callable[[int, list, list[bytes], bytes, bytes], pd.DataFrame], schema: str) -> DataFrame:
    """Each chunk with its answers: `fn(chunk, ids, texts, answers of the first round, of the second)`; each in key order.

    Rounds are told apart by a column `round` of the answers.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        right = right.sort_values(["round", "part"])
        rounds = [b"".join(right.loc[right["round"] == k, "payload"]) for k in (1, 2)]
        out = [fn(int(c), *opened(p), *rounds) for c, p in zip(left["chunk"], left["payload"], strict=True)]
        return out[0] if len(out) == 1 else pd.concat(out)

    return chunks.select("chunk", "payload").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, schema)


def rounds(first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Answers of one or two rounds as one table."""
    every = first.withColumn("round", F.lit(1))
    return every if second is None else every.unionByName(second.withColumn("round", F.lit(2)))
