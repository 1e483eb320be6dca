"""A batch of texts as one array of code points, and hashes of its slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_CHARS = 1_500_000  # code points worked on at once; a longer single text is its own block


def blocks(texts: pa.Array, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` code points each, covering all rows."""
    size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends = np.cumsum(size)
    lo = 0
    while lo < len(ends):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


class Joined:
    """Texts joined with one separator after each; nulls count as empty.

    ``points``: code points, ``start``/``stop``: where each text lies, ``joined``: the string.
    The separator is a code point of its own position, so equal characters inside texts are
    told apart by position only.
    """

    def __init__(self, texts: pa.Array, separator: str = "\n") -> None:
        values = pc.fill_null(texts, "")
        length = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        self.joined = separator.join([*values.to_pylist(), ""])
        self.points = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        self.stop = np.cumsum(length + 1) - 1
        self.start = self.stop - length


class SliceHasher:
    """64-bit polynomial hashes of slices of a code point array (arithmetic modulo 2**64)."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)
    _mix: np.ndarray | None = None

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        cls = SliceHasher
        if cls._mix is None:
            x = np.arange(0x110000, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            cls._mix = x ^ (x >> np.uint64(31))
        if len(cls._powers) <= n:
            size = int(n * 1.2) + 1
            inverse = np.uint64(pow(int(cls.BASE), -1, 1 << 64))
            cls._powers = np.r_[np.uint64(1), np.cumprod(np.full(size, cls.BASE))]
            cls._inverse = np.r_[np.uint64(1), np.cumprod(np.full(size, inverse))]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(cls._mix[points] * cls._powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * SliceHasher._inverse[start]


def distinct_slices(points: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each slice, index of the first slice of each code), exact: equal hashes are compared."""
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code, _ = pd.factorize(SliceHasher(points).of(start, stop))
    n = code.max() + 1
    first = np.empty(n, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    size = stop - start
    lead = first[code]
    wrong = size != size[lead]
    total = int(size.sum())
    ends = np.cumsum(size)
    inside = np.arange(total) - np.repeat(ends - size, size)
    here = points[np.repeat(start, size) + inside]
    there_at = np.minimum(np.repeat(start[lead], size) + inside, len(points) - 1)
    off = here != points[there_at]
    if off.any():
        wrong |= np.add.reduceat(off, ends - size) > 0
    if wrong.any():  # distinct texts under one hash: they get codes of their own
        extra: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(wrong):
            key = points[start[i] : stop[i]].tobytes()
            if key not in extra:
                extra[key] = n + len(more)
                more.append(i)
            code[i] = extra[key]
        first = np.r_[first, np.array(more, np.int64)]
    return code, first
