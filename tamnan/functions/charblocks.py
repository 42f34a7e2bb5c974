"""Texts as blocks of code points, so that character statistics run in numpy instead of Python loops."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np


def blocks(texts: Sequence[str | None], limit: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, code points, offsets) with about ``limit`` code points a block.

    A text longer than ``limit`` makes a block of its own; null counts as an empty text.
    """
    start, size, n = 0, 0, len(texts)
    for i in range(n):
        length = len(texts[i]) if texts[i] is not None else 0
        if size and size + length > limit:
            yield _block(texts, start, i)
            start, size = i, 0
        size += length
    if start < n:
        yield _block(texts, start, n)


def _block(texts: Sequence[str | None], a: int, b: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    rows = [t or "" for t in texts[a:b]]
    offsets = np.zeros(b - a + 1, dtype=np.int64)
    np.cumsum([len(t) for t in rows], out=offsets[1:])
    codes = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return a, b, codes, offsets


def hash_grams(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit polynomial hashes of all windows of ``n`` values (empty if there are fewer)."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(m, dtype=np.uint64)
    c = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + m] + np.uint64(0x632BE59BD9B4E019)
            h ^= h >> np.uint64(29)
    return h
