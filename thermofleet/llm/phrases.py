"""Phrase collocations from fingerprints of all n-grams.

First round: a chunk of documents hashes each run of words with prefix polynomials (Rabin-Karp over word hashes, one per
length), cuts the fingerprints to a width that grows with the corpus, and asks the chunk exchange about its distinct ones,
with their counts. A place in a chunk's sorted question is the occurrence pointer: the range's task sums the counts and
answers, place by place, which fingerprints are frequent. Fingerprints of infrequent n-grams never leave that exchange.

Second round: the chunk goes back to its text at the pointers. There it checks that all n-grams of one full fingerprint are
the same words in the same language, and where they are not (a collision) counts them apart. Only these phrases are written
out as text; their counts are summed by text, so no collision of any fingerprint can change a number.

Candidates, parts and scores then come from the table of frequent phrases alone: a part is at least as frequent as the whole.

Words are runs of bytes without blank, split into pieces at punctuation and line ends; A-Z are lower-cased. Everything is per
language, null counting as `und`. A null or empty text has no words. Repeated rows count as often as they occur, and doc_id is
not read. Ties in score go to the more frequent phrase, then to the smaller one in byte order. A very long text is a chunk of
its own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from thermofleet.llm import exchange as X
from thermofleet.llm.hashing import BLOCK, U, concatenated, mixed, ranges, word_hashes
from thermofleet.llm.ranks import numbered
from thermofleet.llm.scoring import _spread as spread, _squeezed as squeezed
from thermofleet.llm.tables import stored

MAX_WORDS = 3
MIN_COUNT = 10
INSIDE_PERCENT = 50  # a phrase goes if a longer one that holds it has this share of its count
LIMIT = 2000
SALTS = 32  # parts of a language that are cut to LIMIT rows before they are ranked together
SPARE_BITS = 12  # width of the first round's fingerprints beyond that of the corpus' number of bytes
UNKNOWN = "und"
# Bytes between words, and bytes between pieces.
BLANKS, BREAKS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"

_WORD = np.ones(256, bool)
_WORD[list(BLANKS + BREAKS)] = False
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _SIZE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)  # odd: the base has an inverse modulo 2 ** 64
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([U(1)], np.full(max(n - 1, 0), base))), dtype=U)


class _Grams:
    """The words of a chunk and the fingerprints of all its n-grams."""

    def __init__(self, prefixes: list[int], texts: list[bytes], max_words: int, full_bits: int = 64):
        names = [t[:n] for n, t in zip(prefixes, texts, strict=True)]
        self.langs = sorted(set(names))
        number = {name: k for k, name in enumerate(self.langs)}
        data, at = concatenated([t[n:] for n, t in zip(prefixes, texts, strict=True)])
        self.data = _LOWER[data]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], _WORD[self.data], [False])).astype(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        piece = np.cumsum(_BREAK[self.data], dtype=np.int64)[self.starts] if len(self.starts) else self.starts
        per_doc = np.diff(np.searchsorted(self.starts, at))
        self.lang = np.repeat(np.array([number[n] for n in names], np.int64), per_doc)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        lang_hash = np.array([int.from_bytes(name[:64], "little") % (1 << 61) + len(name) for name in self.langs], U)
        salt = mixed(lang_hash)[self.lang] if len(self.lang) else self.hashes
        n = len(self.starts)
        with np.errstate(over="ignore"):
            prefix = np.concatenate((np.zeros(1, U), np.cumsum(self.hashes * _powers(_BASE, n), dtype=U)))
            back, self.places, self.keys = _powers(_INVERSE, n), [], []
            for size in range(1, max_words + 1):
                here = np.flatnonzero(piece[size - 1:] == piece[: max(n - size + 1, 0)])  # within one piece
                gram = (prefix[here + size] - prefix[here]) * back[here]
                self.places.append(here)
                self.keys.append(mixed(gram + salt[here] + _SIZE * U(size)) >> U(64 - full_bits) << U(64 - full_bits))

    def short(self, bits: int) -> np.ndarray:
        return np.concatenate(self.keys) >> U(64 - bits)

    def words(self) -> np.ndarray:
        """A number for each word: equal if and only if its bytes are. Hashes are checked against the text."""
        _, where, inverse = np.unique(self.hashes, return_index=True, return_inverse=True)
        size, same = self.ends - self.starts, where[inverse]
        for k in range(0, len(same), BLOCK):
            a, b = slice(k, k + BLOCK), same[k:k + BLOCK]
            if (size[a] != size[b]).any() or (self.data[ranges(self.starts[a], self.ends[a] - 1)] != self.data[ranges(self.starts[b], self.ends[b] - 1)]).any():
                seen: dict[bytes, int] = {}
                blob = self.data.tobytes()
                return np.array([seen.setdefault(blob[s:e], len(seen)) for s, e in zip(self.starts, self.ends, strict=True)], np.int64)
        return inverse

    def counted(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per size: first place, fingerprint and count of every distinct n-gram among the wanted ones."""
        number, at = self.words(), 0
        for size, (places, keys) in enumerate(zip(self.places, self.keys, strict=True), 1):
            use = np.flatnonzero(wanted[at:at + len(places)])
            at += len(places)
            here, own = places[use], keys[use]
            _, where, inverse, counts = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
            first = here[where]
            same = self.lang[here] == self.lang[first[inverse]]
            for k in range(size):
                same &= number[here + k] == number[first[inverse] + k]
            if not same.all():  # a collision: told apart by what they are
                exact = np.stack([self.lang[here], *[number[here + k] for k in range(size)]], axis=1)
                _, where, counts = np.unique(exact, axis=0, return_index=True, return_counts=True)
                first = here[where]
            yield first, own[where], counts

    def texts(self, first: np.ndarray, size: int) -> list[bytes]:
        """The phrases of `size` words that begin at the words `first`, joined by single spaces."""
        blob = self.data.tobytes()
        begin, end = self.starts[first].tolist(), self.ends[first + size - 1].tolist()
        out = [blob[a:b] for a, b in zip(begin, end, strict=True)]
        odd = np.zeros(len(first), bool)
        for k in range(size - 1):
            gap = self.ends[first + k]
            odd |= (self.starts[first + k + 1] != gap + 1) | (self.data[gap] != 32)
        for k in np.flatnonzero(odd).tolist():
            out[k] = b" ".join(blob[self.starts[w]:self.ends[w]] for w in range(first[k], first[k] + size))
        return out


def _summed(min_count: int):
    def frequent(payloads: list[bytes]) -> list[bytes]:
        each = [spread(p, ("<u8", "<u4")) for p in payloads]
        keys = np.concatenate([np.cumsum(e[0], dtype=U) for e in each])
        _, inverse = np.unique(keys, return_inverse=True)
        often = (np.bincount(inverse, np.concatenate([e[1] for e in each])) >= min_count).astype(np.uint8)[inverse]
        return [squeezed(part) for part in np.split(often, np.cumsum([len(e[0]) for e in each])[:-1])]

    return frequent


def _packed(names: list[bytes], counts: np.ndarray) -> bytes:
    """Phrases in byte order with their counts; no phrase holds a line feed."""
    order = sorted(range(len(names)), key=names.__getitem__)
    text = b"\n".join([names[k] for k in order])
    body = pa.Codec("zstd", 1).compress(text, asbytes=True)
    return np.array([len(text), len(body)], "<u8").tobytes() + body + squeezed(counts[order].astype("<u8"))


def _unpacked(payload: bytes) -> tuple[list[bytes], list[int]]:
    size, stop = np.frombuffer(payload, "<u8", 2).tolist()
    text = pa.Codec("zstd").decompress(payload[16:16 + stop], size, asbytes=True)
    return text.split(b"\n"), spread(payload[16 + stop:], ("<u8",))[0].tolist()


def frequent_phrases(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, chunk_bytes: int = X.CHUNK_BYTES, bits: int | None = None, full_bits: int = 64,
) -> DataFrame:
    """lang, phrase, words, n of every phrase of up to `max_words` words with n >= `min_count`; and per language an empty phrase
    of no words whose n is the number of all words. `bits`, `full_bits`: widths of the fingerprints, whatever they are the
    result is the same."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    # the exchange carries a number and a text: the text begins with the language, the number is where it ends
    marked = docs.select(F.octet_length(lang).alias("doc_id"), F.concat(lang, F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    chunks = X.chunked(marked, chunk_bytes)
    total = chunks.agg(F.sum("text_bytes")).first()[0] or 0
    parts = X.parts_for(chunks, 0.75)
    width = bits or min(64, total.bit_length() + SPARE_BITS)
    left_over = U(width - (parts.bit_length() - 1))

    def ask_counts(chunk: int, prefixes: list, texts: list[bytes]) -> Iterator:
        keys, n = np.unique(_Grams(prefixes, texts, max_words, full_bits).short(width), return_counts=True)
        bounds = np.searchsorted(keys >> left_over, np.arange(parts + 1, dtype=U))
        for part in np.flatnonzero(np.diff(bounds)).tolist():
            here = slice(bounds[part], bounds[part + 1])
            yield part, chunk, squeezed(np.diff(keys[here], prepend=U(0)), n[here].astype("<u4"))

    often = X.answer(X.ask(chunks, ask_counts), _summed(min_count))

    def materialise(chunk: int, prefixes: list, texts: list[bytes], one: bytes, _: bytes) -> pd.DataFrame:
        grams = _Grams(prefixes, texts, max_words, full_bits)
        _, inverse = np.unique(grams.short(width), return_inverse=True)
        flags = spread(one, ("u1",))[0]
        names, langs, where, counts = [], [], [], []
        for size, (first, keys, n) in enumerate(grams.counted(flags[inverse] > 0 if len(flags) else inverse > 0), 1):
            names += grams.texts(first, size)
            langs.append(grams.lang[first])
            where.append((mixed(keys) % U(parts)).astype(np.int64))
            counts.append(n)
        for k, n in enumerate(np.bincount(grams.lang, minlength=len(grams.langs)).tolist()):
            names.append(b"")
            langs.append([k])
            where.append([zlib.crc32(grams.langs[k]) % parts])
            counts.append([n])
        langs, where, counts = (np.concatenate(x).astype(np.int64) for x in (langs, where, counts)) if names else (np.zeros(0, np.int64),) * 3
        order, rows = np.lexsort((where, langs)), []
        cuts = np.flatnonzero(np.diff(langs[order]) | np.diff(where[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            own = group.tolist()
            rows.append((int(where[own[0]]), grams.langs[langs[own[0]]].decode(), _packed([names[k] for k in own], counts[group])))
        return pd.DataFrame(rows, columns=["part", "lang", "payload"])

    found = X.meet(chunks, X.rounds(often), materialise, "part int, lang string, payload binary")

    def add(table: pa.Table) -> pa.Table:
        sums: dict[bytes, int] = {}
        for payload in table.column("payload"):
            for name, n in zip(*_unpacked(payload.as_py()), strict=True):
                sums[name] = sums.get(name, 0) + n
        kept = [(name.decode(), n) for name, n in sums.items() if n >= min_count or not name]
        words = [name.count(" ") + 1 if name else 0 for name, _ in kept]
        lang = table.column("lang")[0].as_py()
        return pa.table({
            "lang": pa.array([lang] * len(kept), pa.string()), "phrase": pa.array([k for k, _ in kept], pa.string()),
            "words": pa.array(words, pa.int32()), "n": pa.array([n for _, n in kept], pa.int64()),
        })

    summed = found.groupBy("part", "lang").applyInArrow(add, "lang string, phrase string, words int, n long")
    return stored(summed, "phrases")


def _part_of(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(phrases: DataFrame, max_words: int = MAX_WORDS, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer candidate covers. `phrases`: as from `frequent_phrases`."""
    words, size = F.split("phrase", " "), F.col("words")
    candidates = phrases.where("words >= 2")
    cut = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(0).alias("side"), _part_of(words, F.lit(1), k).alias("part")),
        F.struct(k.alias("k"), F.lit(1).alias("side"), _part_of(words, k + 1, size - k).alias("part")),
    )))
    asked = candidates.select("lang", "phrase", F.col("n").alias("a"), F.explode(cut).alias("c")).select("lang", "phrase", "a", "c.*")
    known = phrases.where("words >= 1").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    rows = asked.join(known, ["lang", "part"]).select("lang", "phrase", "a", "k", "side", "f")
    if max_words > 2:
        shorter = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: _part_of(words, i, n))))
        inside = candidates.where("words >= 3").select("lang", F.explode(F.array_distinct(shorter)).alias("phrase"), F.col("n").alias("f"))
        rows = rows.unionByName(inside.withColumn("side", F.lit(2)), allowMissingColumns=True)
    wide = "decimal(20,0)"
    met = rows.groupBy("lang", "phrase").agg(
        F.max("a").cast(wide).alias("a"), F.max(F.when(F.col("side") == 2, F.col("f"))).alias("over"),
        *[F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).cast(wide).alias(f"{name}{k}") for k in range(1, max_words) for side, name in enumerate("lr")],
    )
    # 38 digits: counts up to 10 ** 16
    scores = [F.when(F.col(f"l{k}").isNotNull(), F.struct(
        F.expr(f"(cast(1000000 as decimal(7,0)) * a * a) div (l{k} * r{k})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"),
    )) for k in range(1, max_words)]
    least = met.where(F.col("over").isNull() | (100 * F.col("over") < inside_percent * F.col("a"))).withColumn("least", F.array_min(F.array_compact(F.array(*scores))))
    return least.select("lang", "phrase", *[F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("a", "least.l", "least.r", "least.score")])


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, inside_percent: int = INSIDE_PERCENT, limit: int | None = LIMIT, **sizes: int,
) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's first `limit` phrases (all for None)."""
    phrases = frequent_phrases(docs, max_words, min_count, **sizes)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    found = scored(phrases, max_words, inside_percent)
    if limit is not None:  # no part of a language can hold more of its first rows
        salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
        found = found.withColumn("_at", F.row_number().over(salted)).where(F.col("_at") <= limit).drop("_at")
    placed = numbered(found, ["lang"], order).withColumn("rank", F.col("rank") + 1).drop("n")
    if limit is not None:
        placed = placed.where(F.col("rank") <= limit)
    totals = phrases.where("words = 0").select("lang", "n")
    return placed.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
