"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

Suffixes are kept in buckets that a 64-bit identifier names. The initial buckets are those of q-grams (64 bytes). A bucket
with one suffix is done. The others are refined by sorting on identifiers of later offsets: the identifier of 128 bytes is
made from those of the 64 bytes here and 64 bytes on, and the identifier of 200 bytes from that one at this offset and again
72 bytes on, so that every refinement reuses the one before. Identifiers are derived from content, so a bucket has the same
name in every task and no array of all suffixes is needed; ranges of names are sorted apart.

The first round does not send every suffix. In each string of 200 bytes one q-gram is chosen by its hash, the same in every
occurrence; it stands for a run of strings, and a block name for all bytes of that run. A q-gram bucket that holds one suffix
ends all its strings; one whose suffixes have one block in common makes them all repeated. Only mixed buckets are refined to
200 bytes, and each different block is sent once, whatever its number of copies.

A null or empty text has no bytes. Rows with one doc_id are places of their own. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from thermofleet.llm import exchange as X
from thermofleet.llm.hashing import U, anchors, byte_grams, concatenated, covered, joined, mixed, ranges, spans

LENGTH = 200
Q = 64
SINGLE, ALIKE, SENDS, COPY = 0, 1, 2, 3  # verdicts on a (q-gram, block) pair; SENDS + 4 if the block is repeated


class _Suffixes:
    """The bytes of a chunk with q-gram identifiers and the runs of strings that share a chosen q-gram."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        data, self.at = concatenated(texts)
        self.grams = byte_grams(data, Q)
        left = np.repeat(self.at[1:] - 1, np.diff(self.at)) - np.arange(len(data))  # bytes from here to the document's end
        valid = left[: max(len(data) - length + 1, 0)] >= length
        self.anchor, self.begin, self.end = anchors(self.grams, length - Q + 1, valid) if len(valid) else (np.zeros(0, np.int64),) * 3

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (q-gram, block) pairs in order: both names, how often, first run of each, and each run's pair."""
        # the least of many hashes are small; mixed once more they spread evenly over the key ranges
        gram, b, e = mixed(self.grams[self.anchor]), self.begin, self.end
        size = e - b + self.length
        block = mixed(size.astype(U))
        step = 0
        while step < 2 * self.length - Q:  # q-grams at every Q bytes, and back from the end, cover all bytes of a block
            block = joined(block, self.grams[b + np.minimum(step, size - Q)])
            step += Q
        order = np.lexsort((block, gram))
        g, k = gram[order], block[order]
        new = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])))) if len(g) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate((new, [len(g)])))
        pair = np.empty(len(g), np.int64)
        pair[order] = np.repeat(np.arange(len(new)), n)
        return g[new], k[new], n, order[new], pair

    def refined(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the runs given: starts of their strings, distinct names of the strings, how often, each start's name."""
        starts = ranges(self.begin[runs], self.end[runs])
        double = lambda at: joined(self.grams[at], self.grams[at + Q])
        names = joined(double(starts), double(starts + self.length - 2 * Q)) if self.length > 2 * Q else joined(self.grams[starts], self.grams[starts + self.length - Q])
        keys, inverse, n = np.unique(names, return_inverse=True, return_counts=True)
        return starts, keys, n, inverse


def _verdicts(payloads: list[bytes]) -> list[bytes]:
    """Refine the q-gram buckets of a range by their blocks."""
    each = [X.unpacked(p, "<u8", "<u8", "<u4") for p in payloads]
    gram, block, n = (np.concatenate([e[k] for e in each]) for k in range(3))
    order = np.lexsort((block, gram))  # stable: the first of a block is in the first chunk that has it
    g, k = gram[order], block[order]
    new_gram = np.concatenate(([True], g[1:] != g[:-1]))
    new_block = new_gram | np.concatenate(([True], k[1:] != k[:-1]))
    of_gram, of_block = np.cumsum(new_gram) - 1, np.cumsum(new_block) - 1
    blocks = np.bincount(of_gram, new_block)[of_gram]
    copies = np.bincount(of_block, n[order])[of_block]
    found = np.where(blocks == 1, np.where(copies > 1, ALIKE, SINGLE), np.where(new_block, SENDS + 4 * (copies > 1), COPY)).astype(np.uint8)
    out = np.empty(len(g), np.uint8)
    out[order] = found
    return [part.tobytes() for part in np.split(out, np.cumsum([len(e[0]) for e in each])[:-1])]


def _elsewhere(payloads: list[bytes]) -> list[bytes]:
    each = [X.unpacked(p, "<u8")[0] for p in payloads]
    _, inverse, n = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    many = (n > 1).astype(np.uint8)[inverse]
    return [part.tobytes() for part in np.split(many, np.cumsum([len(e) for e in each])[:-1])]


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, spans of removed bytes (start, end) and kept, the remaining bytes.

    `length` is at least 2 * Q and at most 4 * Q, so that the q-grams of a string cover it.
    """
    if not 2 * Q <= length <= 4 * Q:
        raise ValueError(f"length must be between {2 * Q} and {4 * Q}")
    chunks = X.chunked(docs)
    parts = X.parts_for(chunks, 0.35)

    def ask_pairs(chunk: int, ids: list, texts: list[bytes]) -> Iterator:
        gram, block, n, _, _ = _Suffixes(texts, length).pairs()
        yield from X.by_range(chunk, parts, gram, block, n.astype("<u4"))

    first = X.answer(X.ask(chunks, ask_pairs), _verdicts)

    def sent(own: _Suffixes, answers: bytes) -> tuple:
        """Verdict of each run, and the refined strings of the runs to send."""
        _, _, _, run, pair = own.pairs()
        verdict = np.frombuffer(answers, np.uint8)
        return verdict[pair], own.refined(run[(verdict & 3) == SENDS])

    def ask_strings(chunk: int, ids: list, texts: list[bytes], answers: bytes, _: bytes) -> pd.DataFrame:
        _, (_, keys, _, _) = sent(_Suffixes(texts, length), answers)
        return pd.DataFrame(list(X.by_range(chunk, parts, keys)), columns=["part", "chunk", "payload"])

    second = X.answer(X.meet(chunks, X.rounds(first), ask_strings, X.ASKED), _elsewhere)

    def remove(chunk: int, ids: list, texts: list[bytes], one: bytes, two: bytes) -> pd.DataFrame:
        own = _Suffixes(texts, length)
        verdict, (starts, keys, n, inverse) = sent(own, one)
        repeated = (verdict == ALIKE) | (verdict == COPY) | (verdict == SENDS + 4)
        more = starts[((n > 1) | (np.frombuffer(two, np.uint8) > 0))[inverse]] if len(keys) else starts
        drop = np.union1d(ranges(own.begin[repeated], own.end[repeated]), more)
        gone, out = covered(drop, length, int(own.at[-1])), []
        for k, (doc, text) in enumerate(zip(ids, texts, strict=True)):
            mask = gone[own.at[k]:own.at[k] + len(text)]
            if mask.any():
                out.append((doc, len(text), [{"start": a, "end": b} for a, b in spans(mask)], np.frombuffer(text, np.uint8)[~mask].tobytes()))
            else:
                out.append((doc, len(text), [], text))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return X.meet(chunks, X.rounds(first, second), remove, schema)
