"""Language-model scores by a weighted backoff automaton.

The upper states are words: every training word, and the begin of a text, has an arc for each word (or end) that follows it in
training, and a failure arc of weight PRIOR / (count + PRIOR) to the class states below. An arc's probability is
(count of the pair + PRIOR * probability below) / (count of the first word + PRIOR), so a state's probabilities sum to one.

The states below are histories of word classes, which answer for pairs that training lacks: a word's class comes from its
last bytes, so there are at most 64 * 64 of them, each with discounted arcs and a failure arc to the shorter history. There a
word's own probability is its share of the training tokens of its class. One pass over a text, left to right, carries both
states and adds up log-probabilities.

Counts of words and of word pairs are gathered by the chunk exchange: every chunk asks for those of its distinct words and
pairs, tells its own training counts with the question, and gets the sums back.

A null or empty text is only the end token. A row without doc_id is a training row. Repeated rows count as often as they
occur. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thermofleet.llm import exchange as X
from thermofleet.llm.hashing import U, concatenated, joined, mixed, word_hashes, word_spans
from thermofleet.llm.tables import stored

CLASSES = 64  # 62 of words, one of the end, one that only begins histories
END, BEGIN = CLASSES - 2, CLASSES - 1
DISCOUNT = 0.75
SUFFIX = 3  # bytes of a word that choose its class
PRIOR = 20.0  # weight of the class states in a word's state, in tokens
PAIR = 255  # in place of a class: the key is of a word pair
_BEGIN_KEY, _END_KEY = U(0x5BD1E9955BD1E995), U(0x27D4EB2F27D4EB2F)  # stand for a word's hash
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class _Tokens:
    """The words of a chunk: hash and class of each, their distinct hashes, those of word pairs, and who trains."""

    def __init__(self, ids: list, texts: list[bytes]):
        data, at = concatenated(texts)
        data = _LOWER[data]
        starts, ends = word_spans(data)
        self.first = np.searchsorted(starts, at)
        self.sizes = np.diff(self.first)
        self.trains = np.array([not held_out(i) for i in ids], bool)
        self.train_words = np.repeat(self.trains, self.sizes)
        suffix = np.zeros(len(starts), U)
        for k in range(1, SUFFIX + 1):  # fewer bytes in shorter words
            place = ends - k
            suffix = suffix * U(257) + np.where(place >= starts, data[place].astype(U) + U(1), U(0))
        self.classes = (mixed(suffix + U(1)) % U(END)).astype(np.uint8)
        self.hashes, self.starts = word_hashes(data, starts, ends), self.first[:-1]
        self.stops = self.first[1:]

    def asked(self) -> None:
        """Distinct keys of words and of pairs, and their common order in the exchange."""
        self.keys, where, self.inverse = np.unique(self.hashes, return_index=True, return_inverse=True)
        pairs = joined(np.insert(self.hashes, self.starts, _BEGIN_KEY), np.insert(self.hashes, self.stops, _END_KEY))
        self.pairs, self.pair_inverse = np.unique(pairs, return_inverse=True)
        both = np.concatenate((self.keys, self.pairs))
        self.order = np.argsort(both)
        self.all_keys = both[self.order]
        self.kinds = np.concatenate((self.classes[where], np.full(len(self.pairs), PAIR, np.uint8)))[self.order]

    def training(self) -> np.ndarray:
        """Training count of each of `all_keys` in this chunk."""
        pairs = np.bincount(self.pair_inverse, np.repeat(self.trains, self.sizes + 1), len(self.pairs))
        return np.concatenate((np.bincount(self.inverse, self.train_words, len(self.keys)), pairs))[self.order].astype("<u4")

    def placed(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of `all_keys` as one per word and one per pair of the texts."""
        own = np.empty(len(counts), counts.dtype)
        own[self.order] = counts
        return own[: len(self.keys)][self.inverse], own[len(self.keys):][self.pair_inverse]

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all texts, each as begin, begin, its words, end; and where each text's words begin."""
        begin = self.first[:-1] + 3 * np.arange(len(self.sizes)) + 2
        out = np.full(len(self.classes) + 3 * len(self.sizes), BEGIN, np.int64)
        out[np.arange(len(self.classes)) + np.repeat(begin - self.first[:-1], self.sizes)] = self.classes
        out[begin + self.sizes] = END
        return out, begin


def _class_counts(chunks: DataFrame) -> np.ndarray:
    """Training counts of all class trigrams (first, second, third). Summed in two rounds of tasks; the result has a fixed size."""
    cells = CLASSES ** 3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for payload in batch.column(0):
                tokens = _Tokens(*X.opened(payload.as_py()))
                seq, begin = tokens.sequences()
                use = np.repeat(tokens.trains, tokens.sizes + 3)
                use[begin - 2] = use[begin - 1] = False
                at = np.flatnonzero(use)
                total += np.bincount((seq[at - 2] * CLASSES + seq[at - 1]) * CLASSES + seq[at], minlength=cells)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for payload in batch.column(0):
                total += np.frombuffer(payload.as_py(), np.int64)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    own = chunks.select("payload").mapInArrow(count, "counts binary")
    some = stored(own.repartition(16).mapInArrow(add, "counts binary"), "class-counts")
    total = np.zeros(cells, np.int64)
    for row in some.toLocalIterator():  # 16 rows of 2 MB, one at a time
        total += np.frombuffer(bytes(row["counts"]), np.int64)
    return total.reshape(CLASSES, CLASSES, CLASSES)


class BackoffAutomaton:
    """States, arcs and failure arcs of the class model; state 0 is the empty history."""

    def __init__(self, counts: np.ndarray):
        three, two = counts.astype(float), counts.sum(axis=0).astype(float)
        one = two.sum(axis=0)
        self.ends = int(one[END])  # one in each training text
        root = (one + 0.5) / (one.sum() + 0.5 * (CLASSES - 1))
        root[BEGIN] = 0.0  # never read
        self.histories = [()] + [(b,) for b in np.flatnonzero(two.sum(axis=1)).tolist()]
        self.histories += [(int(a), int(b)) for a, b in zip(*np.nonzero(three.sum(axis=2)), strict=True)]
        self.number = {h: k for k, h in enumerate(self.histories)}
        self.failure = [0] + [self.number[h[1:]] for h in self.histories[1:]]
        self.backoff = np.zeros(len(self.histories))  # log10 weight of the failure arc
        self.arcs = np.full((len(self.histories), CLASSES), np.nan)  # log10 on the state's own arcs
        full = np.zeros((len(self.histories), CLASSES))  # probabilities with failure arcs followed
        full[0] = root
        with np.errstate(divide="ignore"):
            self.arcs[0] = np.log10(root)
            for k, h in enumerate(self.histories[1:], 1):  # shorter histories come first
                n = two[h[0]] if len(h) == 1 else three[h]
                seen, below = n > 0, full[self.failure[k]]
                rest = 1.0 - below[seen].sum()
                keep = DISCOUNT * seen.sum() / n.sum() if rest > 1e-9 else 0.0
                own = np.where(seen, (n - (DISCOUNT if keep else 0.0)) / n.sum(), 0.0)
                weight = keep / rest if keep else 0.0
                full[k] = np.where(seen, own, weight * below)
                self.arcs[k][seen] = np.log10(own[seen])
                self.backoff[k] = np.log10(weight) if weight else -np.inf

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        """Follow failure arcs until a state has an arc for the symbol."""
        total, history = 0.0, self.histories[state]
        while np.isnan(self.arcs[state, symbol]):
            total += self.backoff[state]
            state = self.failure[state]
        total += self.arcs[state, symbol]
        after = (*history, symbol)[-2:]
        while after not in self.number:
            after = after[1:]
        return self.number[after], total

    def closed(self) -> tuple[list[int], list[float]]:
        """Next row and log-probability at state * CLASSES + symbol, failure arcs followed once and for all."""
        after, logs = [], []
        for state in range(len(self.histories)):
            for symbol in range(CLASSES):
                to, value = self.step(state, symbol)
                after.append(to * CLASSES)
                logs.append(float(value))
        return after, logs

    def start(self) -> int:
        history = (BEGIN, BEGIN)
        while history not in self.number:
            history = history[1:]
        return self.number[history] * CLASSES


_ASKED, _ANSWER = ("<u8", "<u4", "u1"), ("<i8",)
_HEAD = np.dtype("<u4")


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, byte by byte of their values, compressed: sorted keys as differences, small counts as bytes."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)
    body = pa.Codec("zstd", 1).compress(planes, asbytes=True)
    return np.array([len(arrays[0]), len(body)], _HEAD).tobytes() + body


def _spread(payload: bytes, types: tuple[str, ...]) -> list[np.ndarray]:
    """The arrays of one or more squeezed payloads that follow each other."""
    width, at, found = sum(np.dtype(t).itemsize for t in types), 0, [[np.zeros(0, t)] for t in types]
    while at < len(payload):
        n, size = np.frombuffer(payload, _HEAD, 2, at).tolist()
        at += 2 * _HEAD.itemsize
        planes = np.frombuffer(pa.Codec("zstd").decompress(payload[at:at + size], n * width, asbytes=True), np.uint8).reshape(width, n)
        at, row = at + size, 0
        for t, out in zip(types, found, strict=True):
            k = np.dtype(t).itemsize
            out.append(np.ascontiguousarray(planes[row:row + k].T).reshape(-1).view(t))
            row += k
    return [np.concatenate(out) for out in found]


def _questions(chunk: int, parts: int, t: _Tokens) -> Iterator[tuple[int, int, bytes]]:
    n, at = t.training(), X.cuts(t.all_keys, parts)
    for part in np.flatnonzero(at[1:] > at[:-1]).tolist():
        here = slice(at[part], at[part + 1])
        yield part, chunk, _squeezed(np.diff(t.all_keys[here], prepend=U(0)), n[here], t.kinds[here])


def _totals(frame: pd.DataFrame) -> pd.DataFrame:
    """Training count of each asked key over all chunks; and, in a row of chunk -1, distinct training words by class."""
    frame = frame.sort_values("chunk", kind="stable")
    each = [_spread(p, _ASKED) for p in frame["payload"]]
    found, where, inverse = np.unique(np.concatenate([np.cumsum(e[0], dtype=U) for e in each]), return_index=True, return_inverse=True)
    n = np.bincount(inverse, np.concatenate([e[1] for e in each]), len(found)).astype("<i8")
    kinds = np.concatenate([e[2] for e in each])[where]
    answers = [_squeezed(part) for part in np.split(n[inverse], np.cumsum([len(e[0]) for e in each])[:-1])]
    distinct = np.bincount(kinds[(n > 0) & (kinds != PAIR)], minlength=CLASSES).tolist()
    part = int(frame["part"].iloc[0])
    return pd.DataFrame({"part": part, "chunk": [*frame["chunk"], -1], "payload": [*answers, None], "distinct": [*[None] * len(answers), distinct]})


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    chunks = X.chunked(docs)
    parts = X.parts_for(chunks, 0.5)
    class_counts = _class_counts(chunks)
    automaton = BackoffAutomaton(class_counts)
    after, logs = automaton.closed()

    def ask_counts(chunk: int, ids: list, texts: list[bytes]) -> Iterator:
        t = _Tokens(ids, texts)
        t.asked()
        yield from _questions(chunk, parts, t)

    answers = X.ask(chunks, ask_counts).groupBy("part").applyInPandas(_totals, f"{X.ASKED}, distinct array<long>")
    answers = stored(answers, "answers")
    counts = answers.where("chunk >= 0").select("part", "chunk", "payload")
    per_class = answers.where("chunk < 0").select(F.posexplode("distinct").alias("class", "distinct")).groupBy("class").agg(F.sum("distinct").alias("distinct"))
    words = {r["class"]: r["distinct"] for r in per_class.collect()}  # one row per class
    class_tokens = class_counts.sum(axis=(0, 1)).astype(float)
    class_tokens[END:] = 0.0
    class_words = np.array([words.get(c, 0) for c in range(CLASSES)], float)
    ends = automaton.ends
    n_all, v_all = int(class_tokens.sum()) + ends, int(class_words.sum()) + (ends > 0)
    in_class = np.log10(class_tokens + 0.5 * (class_words + 1))
    base_of = np.log10(n_all + 0.5 * (v_all + 1))
    shared = spark.sparkContext.broadcast((after, logs, automaton.start()))  # bounded by the number of classes

    def score(chunk: int, ids: list, texts: list[bytes], one: bytes, _: bytes) -> pd.DataFrame:
        t = _Tokens(ids, texts)
        t.asked()
        n, n_pair = t.placed(_spread(one, _ANSWER)[0])
        own = np.log10(n + 0.5)
        to, weight, start = shared.value
        seq, begin = t.sequences()
        seq, below = seq.tolist(), []
        for a, size in zip(begin.tolist(), t.sizes.tolist(), strict=True):
            at = start
            for symbol in seq[a:a + size + 1]:
                at += symbol
                below.append(weight[at])
                at = to[at]
        below = np.array(below) + np.insert(own - in_class[t.classes], t.stops, 0.0)  # an end has no share in a class
        before = np.insert(n, t.starts, ends)  # every training word is followed by a word or an end
        path = np.log10(n_pair + PRIOR * 10.0 ** below) - np.log10(before + PRIOR)
        base, known = (s[t.stops] - s[t.starts] for s in (np.concatenate(([0.0], np.cumsum(x))) for x in (own, n > 0)))
        steps = np.concatenate(([0.0], np.cumsum(path)))[t.first + np.arange(len(t.first))]
        return pd.DataFrame({
            "doc_id": pd.array(ids, "Int64"), "held_out": ~t.trains, "n_tokens": t.sizes + 1,
            "n_known": known.astype(np.int64) + int(ends > 0), "train_tokens": n_all,
            "base_score": base + np.log10(ends + 0.5) - (t.sizes + 1) * base_of, "score": np.diff(steps),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return X.meet(chunks, X.rounds(counts), score, schema)
