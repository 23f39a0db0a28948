"""Units and blocks of the enhancement stream: framing, escapes, start codes."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from .bits import read_seven_bit, seven_bit

#: Unit and block types of the stream format (fixed values).
UNIT_PLAIN, UNIT_KEY = 28, 29
SEQUENCE, GLOBAL, PICTURE, DATA, DATA_TILED, EXTRA, FILLER = range(7)
STOP = 0x80
START = b"\0\0\1"
_START_LIKE = re.compile(rb"\0\0(?=[\0-\3])")


def block_bytes(kind: int, payload: bytes) -> bytes:
    if len(payload) <= 5:
        return bytes([len(payload) << 5 | kind]) + payload
    return bytes([7 << 5 | kind]) + seven_bit(len(payload)) + payload


def escape(data: bytes) -> bytes:
    """Puts a 3 between two zeros and a byte of at most 3, so that no start code appears."""
    return _START_LIKE.sub(b"\0\0\3", data)


def unescape(data: bytes) -> bytes:
    return data.replace(b"\0\0\3", b"\0\0")


def unit(key: bool, blocks: Sequence[tuple[int, bytes]]) -> bytes:
    """One unit with start code, header, escaped blocks and stop byte."""
    kind = UNIT_KEY if key else UNIT_PLAIN
    body = bytes([0x41 | kind << 1, 0xFF]) + b"".join(block_bytes(k, p) for k, p in blocks)
    return START + escape(body) + bytes([STOP])


def read_unit(data: bytes) -> tuple[bool, list[tuple[int, bytes]]]:
    """Key flag and blocks of a unit."""
    body = strip_start(data)
    if not body or body[-1] != STOP:
        raise ValueError("the unit has no stop byte")
    body = unescape(body[:-1])
    kind = body[0] >> 1 & 31
    if kind not in (UNIT_PLAIN, UNIT_KEY):
        raise ValueError(f"unit type {kind}")
    blocks, at = [], 2
    while at < len(body):
        size, block, at = body[at] >> 5, body[at] & 31, at + 1
        if size == 7:
            size, at = read_seven_bit(body, at)
        elif size > 5:
            raise ValueError("reserved size")
        if at + size > len(body):
            raise ValueError("the block ends early")
        blocks.append((block, body[at : at + size]))
        at += size
    return kind == UNIT_KEY, blocks


def split_units(data: bytes) -> list[tuple[int, int]]:
    """(start, length) of the units of a byte stream, start codes of three or four bytes included."""
    starts, at = [], data.find(START)
    while at >= 0:
        starts.append(at - (at > 0 and data[at - 1] == 0 and (not starts or at - 1 >= starts[-1] + 3)))
        at = data.find(START, at + 3)
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], len(data)])]


def strip_start(data: bytes) -> bytes:
    if data[:4] == b"\0" + START:
        return data[4:]
    return data[3:] if data[:3] == START else data


def unit_type(data: bytes) -> int:
    """Type of a base-layer unit: five bits of its second header byte."""
    body = strip_start(data)
    return body[1] >> 3 & 31 if len(body) > 1 else 31


def access_units(data: bytes, pictures_below: int = 11) -> Iterator[tuple[int, int]]:
    """(start, length) of access units: each runs to the next picture unit, the first from the start."""
    units = split_units(data)
    starts = [s for s, n in units if unit_type(data[s : s + n]) < pictures_below]
    if units and not starts:
        yield 0, len(data)
    for k, _ in enumerate(starts):
        begin, end = starts[k] if k else 0, starts[k + 1] if k + 1 < len(starts) else len(data)
        yield begin, end - begin
