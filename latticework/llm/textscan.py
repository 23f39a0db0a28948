"""Vectorised word scanning of Arrow string columns.

Texts are handled as UTF-8 bytes of one Arrow buffer, a few megabytes at a
time, so memory depends on the slice and not on the number of rows.  A word is
a maximal run outside the six ASCII white space bytes, which never occur inside
a multi-byte character, so bytes and code points give the same words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20240607)
_ODD = np.uint64(0x9E3779B97F4A7C15)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
BYTE_CODE_FOLDED = BYTE_CODE[_FOLD]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if len(_POWERS[0]) < n:
        inverse = pow(int(_ODD), -1, 1 << 64)
        for k, base in enumerate((_ODD, np.uint64(inverse))):
            out = np.full(max(n, 1 << 16), base, np.uint64)
            out[0] = 1
            _POWERS[k] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def give_back() -> None:
    """Return freed memory to the system: a worker lives on beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in runs of at most ``limit`` text bytes, or single longer rows."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, start = np.cumsum(size), 0
    while start < len(size):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


class Words:
    """Words of several texts: byte ranges, and the first word of each text."""

    def __init__(self, column: pa.Array):
        self.data, self.at = text_bytes(column)
        n = len(self.data)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(self.at), np.int64)
            return
        space = SPACE[self.data]
        edge = np.empty(n + 1, bool)
        edge[0] = edge[n] = True
        edge[1:n] = space[:-1]
        edge[self.at] = True
        self.start = np.flatnonzero(edge[:n] & ~space)
        edge[1:n] = space[1:]
        edge[0] = False
        edge[self.at] = True
        self.end = np.flatnonzero(edge[1:] & ~space) + 1
        self.first = np.searchsorted(self.start, self.at)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, folded: bool = False) -> np.ndarray:
        """64-bit hash of each word; ``folded`` treats A-Z as a-z."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.data) + 1)
        sums = np.empty(len(self.data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((BYTE_CODE_FOLDED if folded else BYTE_CODE)[self.data] * up[:-1], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def run_sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``run_hash`` makes the hash of any run of codes."""
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes * powers(len(codes) + 1)[0][:-1], out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the codes from start to stop; equal runs have equal hashes anywhere."""
    return mix((sums[stop] - sums[start]) * powers(len(sums))[1][start] + (stop - start).astype(np.uint64))


def windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all full windows of ``width`` words, and their count by text."""
    count = np.maximum(np.diff(first) - width + 1, 0)
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(first[:-1] - before, count), count
