"""Vectorised text kernels over UTF-8 bytes (numpy, inside Arrow batches).

Texts are handled in slices of half a MB or so, so a worker's memory doesn't grow with its partition or batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes handled at once. A longer text is a slice of its own.
SLICE_BYTES = 1 << 19
_ROOT = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def slices(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, past last, bytes, starts): texts as UTF-8, each followed by a zero byte; null counts as empty."""
    i = 0
    while i < len(texts):
        parts, starts, at, j = [], [], 0, i
        while j < len(texts) and (at < SLICE_BYTES or j == i):
            raw = (texts[j] or "").encode("utf-8", "replace")
            if at and at + len(raw) > 2 * SLICE_BYTES:
                break
            starts.append(at)
            parts.append(raw)
            at += len(raw) + 1
            j += 1
        yield i, j, np.frombuffer(b"\0".join(parts) + b"\0", np.uint8), np.array([*starts, at], np.int64)
        i = j


def _table(root: int, n: int) -> np.ndarray:
    steps = np.full(n, root, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_LOW = 1 << 16
#: Powers below 65,536 of an odd root and of its inverse modulo 2**64, and of their 65,536th powers: positions below 2**32.
_UP, _DOWN = ((_table(r, _LOW), _table(pow(r, _LOW, 1 << 64), _LOW)) for r in (int(_ROOT), pow(int(_ROOT), -1, 1 << 64)))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span lies."""
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    for a in range(0, len(data), _LOW):
        part = data[a : a + _LOW].astype(np.uint64)
        part += np.uint64(1)
        part *= _UP[0][: len(part)]
        part *= _UP[1][a >> 16]
        np.cumsum(part, out=total[a + 1 : a + 1 + len(part)])
        total[a + 1 : a + 1 + len(part)] += total[a]
    return mix64((total[end] - total[start]) * _DOWN[0][start & (_LOW - 1)] * _DOWN[1][start >> 16] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


#: Byte classes: white space between words is 9 to 13 and 32, the zero byte ends a text.
_BLANK = np.zeros(256, bool)
_BLANK[[0, 9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True


def words(data: np.ndarray, starts: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, text's first word): words after lower-casing A-Z.

    Words are runs without white space, or, with `alnum`, runs of letters and digits (any byte from 128 up counts).
    The last array has one entry more than there are texts.
    """
    data = _LOWER[data]
    inside = np.concatenate([[False], _ALNUM[data] if alnum else ~_BLANK[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    return span_hashes(data, start, end), start, end, np.searchsorted(start, starts)


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
