"""Encoded data of a picture: flags and chunks in stream order, plain or tiled.

Stream order is plane, then level 1 before level 0, then layer, then tile; a
plane's temporal chunks follow its residual chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

from .bits import BitReader, BitWriter, read_seven_bit, seven_bit
from .prefix import read_sizes, size_chunk


class Chunk(NamedTuple):
    data: bytes = b""
    raw: bool = False

    @property
    def present(self) -> bool:
        return bool(self.data)


#: A slot of the stream: (plane, level, layer), level and layer None for temporal chunks; its chunks by tile.
Slot = tuple[int, int | None, int | None]
NO_CHUNK = Chunk()


def slots(planes: int, layers: int, temporal: bool) -> Iterator[Slot]:
    for plane in range(planes):
        for level in (1, 0):
            for layer in range(layers):
                yield plane, level, layer
        if temporal:
            yield plane, None, None


def flag_runs(flags: list[bool]) -> bytes:
    """First flag as a byte, then the lengths of alternating stretches."""
    out = bytes([int(flags[0]) if flags else 0])
    return out + b"".join(seven_bit(len(list(g))) for _, g in groupby(flags))


def read_flag_runs(data: bytes, at: int, count: int) -> tuple[list[bool], int]:
    now, at, flags = bool(data[at]), at + 1, []
    while len(flags) < count:
        n, at = read_seven_bit(data, at)
        flags += [now] * n
        now = not now
    return flags, at


def write_plain(chunks: dict[Slot, list[Chunk]], planes: int, layers: int, temporal: bool) -> bytes:
    flags, body = BitWriter(), b""
    for slot in slots(planes, layers, temporal):
        c = chunks.get(slot, [NO_CHUNK])[0]
        flags.flag(c.present).flag(c.raw and c.present)
        if c.present:
            body += seven_bit(len(c.data)) + c.data
    return flags.bytes() + body


def read_plain(data: bytes, planes: int, layers: int, temporal: bool) -> dict[Slot, list[Chunk]]:
    src = BitReader(data)
    marks = [(slot, src.flag(), src.flag()) for slot in slots(planes, layers, temporal)]
    at, out = src.byte, {}
    for slot, present, raw in marks:
        out[slot] = [NO_CHUNK]
        if present:
            n, at = read_seven_bit(data, at)
            out[slot] = [Chunk(data[at : at + n], raw)]
            at += n
    return out


def write_tiled(chunks: dict[Slot, list[Chunk]], planes: int, layers: int, temporal: bool, packed_flags: bool, packed_sizes: int) -> bytes:
    order = list(slots(planes, layers, temporal))
    raw, marks = BitWriter(), []
    for slot in order:
        raw.flag(any(c.raw for c in chunks[slot]))
        marks += [c.present for c in chunks[slot]]
    flags = BitWriter()
    for m in marks:
        flags.flag(m)
    out = raw.bytes() + (flag_runs(marks) if packed_flags else flags.bytes())
    for slot in order:
        present = [c.data for c in chunks[slot] if c.present]
        sizes = [len(d) for d in present]
        if packed_sizes == 1:
            out += size_chunk(sizes)
        elif packed_sizes == 2:
            out += size_chunk([b - a for a, b in zip([0, *sizes], sizes)], signed=True)
        for d in present:
            out += d if packed_sizes else seven_bit(len(d)) + d
    return out


def read_tiled(data: bytes, tiles: dict[Slot, int], planes: int, layers: int, temporal: bool, packed_flags: bool, packed_sizes: int) -> dict[Slot, list[Chunk]]:
    order = list(slots(planes, layers, temporal))
    src = BitReader(data)
    raw = {slot: src.flag() for slot in order}
    at, count = src.byte, sum(tiles[s] for s in order)
    if packed_flags:
        marks, at = read_flag_runs(data, at, count)
    else:
        src = BitReader(data, at)
        marks = [src.flag() for _ in range(count)]
        at = src.byte
    out, done = {}, 0
    for slot in order:
        mine, done = marks[done : done + tiles[slot]], done + tiles[slot]
        sizes: list[int] = []
        if packed_sizes:
            sizes, took = read_sizes(data[at:], sum(mine), signed=packed_sizes == 2)
            at += took
            if packed_sizes == 2:
                for k in range(1, len(sizes)):
                    sizes[k] += sizes[k - 1]
        out[slot] = []
        for m in mine:
            if not m:
                out[slot].append(NO_CHUNK)
                continue
            if packed_sizes:
                n = sizes.pop(0)
            else:
                n, at = read_seven_bit(data, at)
            out[slot].append(Chunk(data[at : at + n], raw[slot]))
            at += n
    return out
