"""64-bit hashes of words and windows over the bytes of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
POSITION_BITS = 31  # of a packed (hash, position) value; a chunk of text is shorter than 2 GB
POSITION_MASK = U((1 << POSITION_BITS) - 1)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_SYMBOLS = np.arange(1, 257, dtype=U)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of each value over all bits."""
    shifted = x >> U(32)
    x = x ^ shifted
    x *= _A
    np.right_shift(x, U(29), out=shifted)
    x ^= shifted
    x *= _B
    np.right_shift(x, U(32), out=shifted)
    x ^= shifted
    return x


_SYMBOLS = mixed(_SYMBOLS * _C)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the concatenation of what two hashes stand for (of fixed lengths)."""
    return mixed(a * _B + (b ^ _C) * _A + (b >> U(31)))


BLOCK = 1 << 16  # positions worked on at a time, so that they stay in a core's cache


def blocked(fn: Callable[[np.ndarray], np.ndarray], values: np.ndarray, reach: int) -> np.ndarray:
    """`fn` over windows of `reach` values, block by block: fn(v) has len(v) - reach + 1 results."""
    n = max(len(values) - reach + 1, 0)
    parts = [fn(values[a:min(a + BLOCK, n) + reach - 1]) for a in range(0, n, BLOCK)]
    return np.concatenate(parts) if parts else np.zeros(0, U)


def byte_grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of `size` (a power of two) neighbouring bytes at each start: a polynomial over random symbols, by doubling."""

    def run(part: np.ndarray) -> np.ndarray:
        at, width, power = _SYMBOLS[part], 1, _C
        while width < size:
            high = at[:-width] * power
            high += at[width:]
            at, width, power = high, 2 * width, power * power
        return mixed(at)

    with np.errstate(over="ignore"):
        return blocked(run, data, size)


def window_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """Hash of `size` neighbouring units at each start, by doubling: a window is two windows of half the size."""
    at, width = units, 1
    while 2 * width <= size:
        at = joined(at[:-width], at[width:]) if len(at) > width else at[:0]
        width *= 2
    if width < size:
        more = size - width
        at = joined(at[:-more], at[more:]) if len(at) > more else at[:0]
    return at


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of `width` neighbouring values at each start, by doubling."""
    at, reach = values, 1
    while 2 * reach <= width:
        at = np.minimum(at[:-reach], at[reach:]) if len(at) > reach else at[:0]
        reach *= 2
    if reach < width:
        more = width - reach
        at = np.minimum(at[:-more], at[more:]) if len(at) > more else at[:0]
    return at


def anchors(hashes: np.ndarray, width: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor of each run of windows: (position of the anchor, first window, last window).

    A window's anchor is the leftmost least of its `width` hashes, so equal windows have their anchor at the same place
    and one anchor serves a run of windows. `valid` marks the window starts that lie in one document.
    """
    packed = (hashes & ~POSITION_MASK) | np.arange(len(hashes), dtype=U)
    least = blocked(lambda part: sliding_min(part, width), packed, width)
    starts = np.flatnonzero(valid[: len(least)])
    if not len(starts):
        return starts, starts, starts
    own = (least[starts] & POSITION_MASK).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1))))
    last = np.concatenate((first[1:] - 1, [len(starts) - 1]))
    return own[first], starts[first], starts[last]


def concatenated(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each followed by a line feed, and the offsets of their starts (with the end)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; the data ends with a blank."""
    inside = np.concatenate(([False], ~BLANK[data]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's bytes: a polynomial over its symbols, mixed with its length."""
    if not len(starts):
        return np.zeros(0, U)
    powers = np.cumprod(np.concatenate(([U(1)], np.full(int((ends - starts).max()), _C))), dtype=U)
    out = np.empty(len(starts), U)
    for k in range(0, len(starts), BLOCK // 8):
        begin = starts[k:k + BLOCK // 8]
        sizes = ends[k:k + BLOCK // 8] - begin
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        terms = _SYMBOLS[data[place + np.repeat(begin, sizes)]] * powers[place]
        out[k:k + BLOCK // 8] = mixed(np.add.reduceat(terms, first) + sizes.astype(U) * _A)
    return out


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges first..last, one range after the other."""
    sizes = last - first + 1
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(before - first, sizes)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n units lie in a window of `width` that begins at one of `starts`."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:-1]) > 0


def spans(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of True as (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
