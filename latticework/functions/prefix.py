"""Prefix codes and the byte chunks made with them.

Code lengths are Huffman's, found with a heap; equal weights go by age and then
symbol, so they depend on the counts alone.  Codes are canonical: among the
longest, the largest symbol has the last code.  Table headers, chunk layouts and
the special forms for no and one symbol follow the stream format.

Writing is numpy throughout: symbols of a whole chunk are arrays, and their codes
are laid out bit by bit at once.  Reading is serial by nature (a code's place is
known when the one before it is read) and takes one table look-up a symbol.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Sequence
from functools import cached_property

import numpy as np

from .bits import BitReader, BitWriter, seven_bit

LOW, HIGH, RUN = 0, 1, 2
LIST_MOST = 31
PEEK = 10


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Length by symbol; a single symbol has length 0."""
    depth = {s: 0 for s, n in sorted(counts.items()) if n}
    heap = [(counts[s], 0, s, [s]) for s in depth]
    heapq.heapify(heap)
    age = 0
    while len(heap) > 1:
        (n, _, s, left), (m, _, t, right) = heapq.heappop(heap), heapq.heappop(heap)
        for symbol in left + right:
            depth[symbol] += 1
        age += 1
        heapq.heappush(heap, (n + m, age, min(s, t), left + right))
    if depth and max(depth.values()) > 31:
        raise ValueError("a code is longer than 31 bits")
    return depth


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length): counted up from the longest codes, largest length first, smallest symbol first."""
    out, code, now = {}, 0, max(lengths.values(), default=0)
    for length, symbol in sorted(((n, s) for s, n in lengths.items()), key=lambda p: (-p[0], p[1])):
        code >>= now - length
        now = length
        out[symbol] = (code, length)
        code += 1
    return out


def width_of_range(span: int) -> int:
    """Bits for a length less the smallest length, given their span."""
    return span.bit_length()


class Table:
    """The prefix code of one context."""

    def __init__(self, lengths: dict[int, int]) -> None:
        self.lengths, self.codes = lengths, canonical(lengths)

    @classmethod
    def of(cls, symbols: Iterable[int]) -> Table:
        return cls(code_lengths(Counter(symbols)))

    @cached_property
    def symbols(self) -> dict[tuple[int, int], int]:
        return {(n, c): s for s, (c, n) in self.codes.items()}

    @cached_property
    def look(self) -> list[tuple[int, int] | None]:
        """(symbol, length) by the next ``PEEK`` bits; nothing where the code is longer."""
        out: list[tuple[int, int] | None] = [None] * (1 << PEEK)
        for symbol, (code, length) in self.codes.items():
            if length <= PEEK:
                at = code << PEEK - length
                out[at : at + (1 << PEEK - length)] = [(symbol, length)] * (1 << PEEK - length)
        return out

    def write(self, out: BitWriter) -> None:
        if not self.lengths:
            out.put(31, 5).put(31, 5)
        elif len(self.lengths) == 1:
            out.put(0, 5).put(0, 5).put(next(iter(self.lengths)), 8)
        else:
            low, high = min(self.lengths.values()), max(self.lengths.values())
            width = width_of_range(high - low)
            out.put(low, 5).put(high, 5)
            listed = len(self.lengths) <= LIST_MOST
            out.flag(not listed)
            if listed:
                out.put(len(self.lengths), 5)
            for symbol in sorted(self.lengths) if listed else range(256):
                if listed:
                    out.put(symbol, 8)
                else:
                    out.flag(symbol in self.lengths)
                if symbol in self.lengths:
                    out.put(self.lengths[symbol] - low, width)

    @classmethod
    def read(cls, src: BitReader) -> Table:
        low, high = src.take(5), src.take(5)
        if low == 31 and high == 31:
            return cls({})
        if low == 0 and high == 0:
            return cls({src.take(8): 0})
        width = width_of_range(high - low)
        if src.flag():
            found = {}
            for symbol in range(256):
                if src.flag():
                    found[symbol] = low + src.take(width)
            return cls(found)
        pairs = [(src.take(8), low + src.take(width)) for _ in range(src.take(5))]
        return cls(dict(pairs))

    def put(self, out: BitWriter, symbol: int) -> None:
        code, length = self.codes[symbol]
        out.put(code, length)

    def take(self, src: BitReader) -> int:
        if (hit := self.look[src.peek(PEEK)]) is not None:
            src.skip(hit[1])
            return hit[0]
        code = length = 0
        while (found := self.symbols.get((length, code))) is None:
            if length > 31:
                raise ValueError("no such code")
            code, length = code << 1 | src.take(1), length + 1
        return found


def _groups(value: np.ndarray) -> np.ndarray:
    """How many groups of seven bits each value has; none for 0."""
    return sum(((value >> 7 * k) > 0).astype(np.int64) for k in range(9))


def _runs(count: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Byte ``place`` of the groups of each owner's value, the high bit set on all but the last."""
    left = _groups(count)[owner] - 1 - place
    return (count[owner] >> 7 * left) & 127 | np.where(left > 0, 128, 0)


def level_symbols(value: np.ndarray, zeros: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte of levels and of the zeros behind each, in stream order."""
    value, zeros = np.asarray(value, np.int64), np.asarray(zeros, np.int64)
    large, runs = ((value < -32) | (value >= 32)).astype(np.int64), _groups(zeros)
    size = 1 + large + runs
    start = np.cumsum(size) - size
    ctx, byte = np.full(int(size.sum()), RUN), np.zeros(int(size.sum()), np.int64)
    wide = value + (1 << 13)
    ctx[start], byte[start] = LOW, np.where(large, wide % 128 * 2 + 1, (value + 32) * 2)
    ctx[start[large > 0] + 1], byte[start[large > 0] + 1] = HIGH, wide[large > 0] // 128
    byte[start + large] |= np.where(zeros > 0, 128, 0)
    owner = np.repeat(np.arange(len(value)), runs)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    byte[(start + 1 + large)[owner] + place] = _runs(zeros, owner, place)
    return ctx, byte


def coded(ctx: np.ndarray, byte: np.ndarray, contexts: int, lead: bytes = b"") -> bytes:
    """Tables of all contexts, ``lead`` and the codes of the symbols."""
    out, code, length = BitWriter(), np.zeros((contexts, 256), np.int64), np.zeros((contexts, 256), np.int64)
    for c in range(contexts):
        counts = np.bincount(byte[ctx == c], minlength=256)
        table = Table(code_lengths({s: int(counts[s]) for s in np.flatnonzero(counts).tolist()}))
        table.write(out)
        for symbol, (bits, n) in table.codes.items():
            code[c, symbol], length[c, symbol] = bits, n
    for b in lead:
        out.put(b, 8)
    bits, n = code[ctx, byte], length[ctx, byte]
    each = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    head = np.unpackbits(np.frombuffer(out.bytes(), np.uint8))[: out.size]
    return np.packbits(np.concatenate([head, (bits[each] >> (n[each] - 1 - place)) & 1]).astype(np.uint8)).tobytes()


def coefficient_chunk(events: Iterable[tuple[int, int]], raw: bool = False) -> bytes:
    """Bytes of (value, zero_run) events; ``raw`` leaves the symbols uncoded."""
    pairs = np.array(list(events), np.int64).reshape(-1, 2)
    return level_chunk(pairs[:, 0], pairs[:, 1], raw)


def level_chunk(value: np.ndarray, zeros: np.ndarray, raw: bool = False) -> bytes:
    ctx, byte = level_symbols(value, zeros)
    return byte.astype(np.uint8).tobytes() if raw else coded(ctx, byte, 3)


def sparse_chunk(place: np.ndarray, value: np.ndarray, total: int) -> bytes:
    """Bytes of a layer of ``total`` levels that is zero but for ``value`` at the ascending ``place``."""
    zeros = np.diff(place, append=total) - 1
    if len(place) == 0 or place[0]:
        first = place[0] if len(place) else total
        value, zeros = np.concatenate([[0], value]), np.concatenate([[first - 1], zeros])
    return level_chunk(value, zeros)


def read_coefficients(data: bytes, total: int, raw: bool = False) -> list[tuple[int, int]]:
    """Events of a chunk that cover ``total`` places."""
    src = BitReader(data)
    tables = None if raw else [Table.read(src) for _ in range(3)]
    take = (lambda ctx: src.take(8)) if raw else (lambda ctx: tables[ctx].take(src))
    events, covered = [], 0
    while covered < total:
        low = take(LOW)
        if low & 1:
            high = take(HIGH)
            value, more = (high & 127) * 128 + (low >> 1) - (1 << 13), high & 128
        else:
            value, more = (low >> 1 & 63) - 32, low & 128
        zeros = 0
        while more:
            byte = take(RUN)
            zeros, more = zeros << 7 | byte & 127, byte & 128
        events.append((value, zeros))
        covered += 1 + zeros
    return events


def nonzero_levels(data: bytes, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a layer's nonzero levels."""
    events = np.array(read_coefficients(data, total), np.int64).reshape(-1, 2)
    place = np.cumsum(events[:, 1] + 1) - events[:, 1] - 1
    hit = events[:, 0] != 0
    return place[hit], events[hit, 0]


def size_chunk(sizes: Sequence[int], signed: bool = False) -> bytes:
    """Bytes of chunk sizes, or of their signed differences."""
    v = np.asarray(sizes, np.int64).reshape(-1)
    wrong = (v < -8192) | (v >= 8192) if signed else (v < 0) | (v >= 16384)
    if wrong.any():
        raise ValueError(f"a size of {v[wrong][0]} cannot be written in 14 bits")
    large = (~((v >= -64) & (v < 64)) if signed else v >= 128).astype(np.int64)
    start = np.cumsum(1 + large) - 1 - large
    ctx, byte = np.zeros(len(v) + int(large.sum()), np.int64), np.zeros(len(v) + int(large.sum()), np.int64)
    byte[start] = v % 128 * 2 + large
    at = start[large > 0] + 1
    ctx[at], byte[at] = HIGH, ((v >> 7) % 128 + np.where(v < 0, 128, 0))[large > 0]
    return coded(ctx, byte, 2)


def read_sizes(data: bytes, count: int, signed: bool = False) -> tuple[list[int], int]:
    """Sizes, and the bytes they took."""
    src = BitReader(data)
    tables = [Table.read(src) for _ in range(2)]
    out = []
    for _ in range(count):
        low = tables[LOW].take(src)
        v = low >> 1
        if low & 1:
            high = tables[HIGH].take(src)
            v += (high & 127) << 7
            if signed and high & 128:
                v -= 1 << 14
        elif signed and v >= 64:
            v -= 128
        out.append(v)
    return out, src.byte


def signal_chunk(runs: Sequence[tuple[int, int]]) -> bytes:
    """Bytes of alternating (signal, count) runs."""
    if any(a[0] == b[0] for a, b in zip(runs, runs[1:])):
        raise ValueError("runs must alternate")
    parts = [(s, seven_bit(n)) for s, n in runs]
    ctx = np.repeat(np.array([s for s, _ in parts], np.int64), [len(b) for _, b in parts])
    return coded(ctx, np.frombuffer(b"".join(b for _, b in parts), np.uint8).astype(np.int64), 2, bytes([runs[0][0]]))


def read_signals(data: bytes, total: int) -> list[tuple[int, int]]:
    src = BitReader(data)
    tables = [Table.read(src) for _ in range(2)]
    signal, runs, covered = src.take(8), [], 0
    while covered < total:
        n, more = 0, 128
        while more:
            byte = tables[signal].take(src)
            n, more = n << 7 | byte & 127, byte & 128
        runs.append((signal, n))
        covered, signal = covered + n, 1 - signal
    return runs
