"""Plain versions of the operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def runs(mask):
    return sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask))


def suffix_dedup(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (doc, _), b in zip(rows, texts, strict=True):
        mask = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                mask[i:i + length] = [True] * length
        out.append((doc, len(b), sum(mask), runs(mask), sha(bytes(x for x, m in zip(b, mask, strict=True) if not m))))
    return out


def best_fit_sequences(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [k for k, r in enumerate(rooms) if r >= n]
        if fitting:
            rooms[min(fitting, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


def trains(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 5 != 1


def base_scores(rows):
    tokens = {k: [*words((t or "").translate(LOWER)), None] for k, (_, t) in enumerate(rows)}
    counts = Counter(x for k, (d, _) in enumerate(rows) if trains(d) for x in tokens[k])
    n, v = sum(counts.values()), len(counts)
    return [
        (d, not trains(d), len(tokens[k]), sum(counts[x] > 0 for x in tokens[k]), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens[k]))
        for k, (d, _) in enumerate(rows)
    ]


def quality(rows):
    out = []
    for doc, text in rows:
        t, ws = text or "", words(text)
        where = defaultdict(list)
        for i in range(len(ws) - 4):
            where[tuple(ws[i:i + 5])].append(i)
        hit = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        symbols, chars = sum(c in "#*$%&|<>" for c in t), sum(map(len, ws))
        failed = len(ws) < 10 or 100 * len(hit) > 20 * len(ws)
        upper = sum("A" <= c <= "Z" for c in t)
        kept = not (failed or 5 * symbols > len(ws) or 4 * upper > chars or chars > 40 * max(len(ws), 1))
        out.append((doc, len(ws), chars, symbols, len(lines) - len(set(lines)), len(hit), failed, kept))
    return out


def fingerprint(text):
    ws = words((text or "").translate(LOWER))
    if not ws:
        return 0
    grams = [" ".join(ws[i:i + 4]) for i in range(max(len(ws) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(rows, bits=4):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(d, f"{fps[i]:016x}", min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)]


def line_dedup(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(list)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(-1 if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == (-1 if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return out


def word_dedup(rows, size=13):
    order = lambda d: math.inf if d is None else d
    least = {}
    for doc, text in rows:
        ws = words(text)
        for i in range(len(ws) - size + 1):
            g = tuple(ws[i:i + size])
            least[g] = min(least.get(g, math.inf), order(doc))
    out = []
    for doc, text in rows:
        ws = words(text)
        gone = set()
        for i in range(len(ws) - size + 1):
            if least[tuple(ws[i:i + size])] < order(doc):
                gone.update(range(i, i + size))
        out.append((doc, len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone).encode())))
    return out


def top_k(rows, k=10):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in {(i, tuple(v)) for i, v in whole if i % 100 == 0}:
        found = sorted(((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in whole if i != q))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return out


def merkle(rows, touched, fan_out=3):
    """rows: (doc_id, source, lang, n_chars, text); per row doc_id, leaf, subroot, root, proof, folded root, verified."""

    def digest(*parts):
        return sha("".join(parts).encode())

    def leaf(row):
        return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def rolled(level):
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for path, p in zip(paths, at, strict=True):
                a = p - p % fan_out
                path.append(("".join(level[a:p]), "".join(level[p + 1:a + fan_out])))
            level, at = [digest(*level[a:a + fan_out]) for a in range(0, len(level), fan_out)], [p // fan_out for p in at]
        return level[0], paths

    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    members = [sorted(groups[s], key=lambda m: m[:3]) for s in names]
    own = [rolled([m[2] for m in ms]) for ms in members]
    root, tops = rolled([subroot for subroot, _ in own]) if own else (None, [])
    out = []
    for ms, (subroot, paths), top in zip(members, own, tops, strict=True):
        for (_, _, h, row), below in zip(ms, paths, strict=True):
            at = h
            if touched(row[0]):
                at = leaf((*row[:4], None if row[4] is None else row[4].replace("\n", "")))
            for left, right in below + top:
                at = digest(left, at, right)
            out.append((row[0], h, subroot, root, digest(*[a + b for a, b in below + top]), at, at == root))
    return out


def phrases(rows, most=3, least=10, percent=50, limit=2000):
    """rows: (lang, text); the ranked rows lang, rank, phrase, a, l, r, n, score."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(own)
            for n in range(1, most + 1):
                counts[lang].update(tuple(own[i:i + n]) for i in range(len(own) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        gone = set()
        for p, n in found.items():
            for size in range(2, len(p)):
                gone |= {q for i in range(len(p) - size + 1) if 100 * n >= percent * f[q := p[i:i + size]]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((" ".join(p), a, f[p[:k]], f[p[k:]], score))
        scored.sort(key=lambda s: (-s[4], -s[1], s[0].encode()))
        out += [(lang, at, *s[:4], totals[lang], s[4]) for at, s in enumerate(scored[:limit], 1)]
    return out
