"""Removal of word windows that an earlier document holds, level by level with doubled lengths.

Level one looks at windows of about half the length. In every full window one of them is chosen by its hash, the same one
wherever the full window occurs, so one short window stands for a run of full ones. Short windows that occur in one document
only rule out their runs. The next level doubles the length: only full windows whose short window is repeated are extended
and compared, and those that a smaller doc_id also holds are removed. Each level works on the input text.

A null or empty text has no words. A null doc_id counts as larger than any other. Rows with one doc_id are one document. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from thermofleet.llm import exchange as X
from thermofleet.llm.hashing import anchors, concatenated, covered, joined, mixed, ranges, spans, window_hashes, word_hashes, word_spans

WINDOW = 13
LAST_ID = np.iinfo(np.int64).max  # stands for a null doc_id


class _Words:
    """The words of a chunk with the hashes of short and full windows, and the runs of full windows."""

    def __init__(self, ids: list, texts: list[bytes], window: int):
        data, at = concatenated(texts)
        starts, ends = word_spans(data)
        self.first = np.searchsorted(starts, at)  # first word of each document, and the number of words
        sizes = np.diff(self.first)
        self.doc = np.repeat(np.array([LAST_ID if i is None else i for i in ids], np.int64), sizes)
        short = (window + 1) // 2
        units = word_hashes(data, starts, ends)
        self.short = window_hashes(units, short)
        self.full = joined(self.short[: -(window - short)], self.short[window - short:]) if len(units) >= window else self.short[:0]
        valid = np.zeros(max(len(self.full), 0), bool)
        left = np.repeat(self.first[1:], sizes) - np.arange(len(units))  # words from here to the document's end
        valid[:] = left[: len(valid)] >= window
        self.anchor, self.begin, self.end = anchors(self.short, window - short + 1, valid) if len(valid) else (np.zeros(0, np.int64),) * 3

    def short_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct short windows, whether two documents of the chunk hold each, and each run's number among them."""
        # the least of several hashes are small; mixed once more they spread evenly over the key ranges
        keys, inverse = np.unique(mixed(self.short[self.anchor]), return_inverse=True)
        doc = self.doc[self.anchor]
        low, high = np.full(len(keys), LAST_ID), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, doc)
        np.maximum.at(high, inverse, doc)
        return keys, low < high, inverse

    def full_keys(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the runs marked: window starts, distinct full windows, the least document of each, each start's number."""
        starts = ranges(self.begin[repeated], self.end[repeated])
        keys, inverse = np.unique(self.full[starts], return_inverse=True)
        low = np.full(len(keys), LAST_ID)
        np.minimum.at(low, inverse, self.doc[starts])
        return starts, keys, low, inverse


def _elsewhere(payloads: list[bytes]) -> list[bytes]:
    """For each key of each chunk: 1 if another chunk asks about it too."""
    each = [X.unpacked(p, "<u8")[0] for p in payloads]
    found, inverse, n = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    many = (n > 1).astype(np.uint8)[inverse]
    return [part.tobytes() for part in np.split(many, np.cumsum([len(e) for e in each])[:-1])]


def _smaller(payloads: list[bytes]) -> list[bytes]:
    """For each key of each chunk: 1 if another chunk's least document is smaller."""
    each = [X.unpacked(p, "<u8", "<i8") for p in payloads]
    keys, low = np.concatenate([e[0] for e in each]), np.concatenate([e[1] for e in each])
    found, inverse = np.unique(keys, return_inverse=True)
    least = np.full(len(found), LAST_ID)
    np.minimum.at(least, inverse, low)
    less = (least[inverse] < low).astype(np.uint8)
    return [part.tobytes() for part in np.split(less, np.cumsum([len(e[0]) for e in each])[:-1])]


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, spans of removed words (start, end) and kept_text, the other words joined by spaces."""
    chunks = X.chunked(docs)
    parts = X.parts_for(chunks, 0.35)

    def ask_short(chunk: int, ids: list, texts: list[bytes]) -> Iterator:
        keys, _, _ = _Words(ids, texts, window).short_keys()
        yield from X.by_range(chunk, parts, keys)

    short = X.answer(X.ask(chunks, ask_short), _elsewhere)

    def repeated_runs(words: _Words, answers: bytes) -> np.ndarray:
        keys, here, inverse = words.short_keys()
        return (here | (np.frombuffer(answers, np.uint8) > 0))[inverse] if len(keys) else np.zeros(0, bool)

    def ask_full(chunk: int, ids: list, texts: list[bytes], first: bytes, _: bytes) -> pd.DataFrame:
        words = _Words(ids, texts, window)
        _, keys, low, _ = words.full_keys(repeated_runs(words, first))
        return pd.DataFrame(list(X.by_range(chunk, parts, keys, low)), columns=["part", "chunk", "payload"])

    full = X.answer(X.meet(chunks, X.rounds(short), ask_full, X.ASKED), _smaller)

    def remove(chunk: int, ids: list, texts: list[bytes], first: bytes, second: bytes) -> pd.DataFrame:
        words = _Words(ids, texts, window)
        starts, keys, low, inverse = words.full_keys(repeated_runs(words, first))
        drop = (words.doc[starts] > low[inverse]) | (np.frombuffer(second, np.uint8) > 0)[inverse] if len(keys) else np.zeros(0, bool)
        gone, out = covered(starts[drop], window, len(words.doc)), []
        for k, (doc, text) in enumerate(zip(ids, texts, strict=True)):
            mask, own = gone[words.first[k]:words.first[k + 1]], text.split()
            if mask.any():
                kept = [w for w, lost in zip(own, mask.tolist(), strict=True) if not lost]
                out.append((doc, len(own), [{"start": a, "end": b} for a, b in spans(mask)], b" ".join(kept).decode()))
            else:
                out.append((doc, len(own), [], b" ".join(own).decode()))
        frame = pd.DataFrame(out, columns=["doc_id", "n_words", "spans", "kept_text"])
        return frame.astype({"doc_id": "Int64"})

    schema = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept_text string"
    return X.meet(chunks, X.rounds(short, full), remove, schema)
