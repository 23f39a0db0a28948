"""A two-track MP4 file: base and enhancement samples in turns.

Places in the file are running sums over rows, worked out by Spark; the boxes
are metadata of a few bytes a sample and are put together on the driver, from
sizes alone.  Media bytes go to the file row by row and are never held together.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIMESCALE = 12800
#: Unit matrix of a track (fixed values).
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
#: Colour names and their code points (fixed values).
PRIMARIES = {"bt709": 1, "bt470m": 4, "bt470bg": 5, "smpte170m": 6, "smpte240m": 7, "film": 8, "bt2020": 9, "smpte428": 10, "smpte431": 11, "smpte432": 12}
TRANSFERS = {"bt709": 1, "gamma22": 4, "gamma28": 5, "smpte170m": 6, "smpte240m": 7, "linear": 8, "iec61966-2-1": 13, "bt2020-10": 14, "bt2020-12": 15, "smpte2084": 16, "arib-std-b67": 18}
MATRICES = {"rgb": 0, "bt709": 1, "fcc": 4, "bt470bg": 5, "smpte170m": 6, "smpte240m": 7, "bt2020nc": 9, "bt2020c": 10}


def sample_offsets(rows: DataFrame, keys: list[str], delta: int) -> DataFrame:
    """(keys, i, base_offset, enhancement_offset, composition) from sample sizes and display places (poc)."""
    before = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("base_size") + F.col("enhancement_size")).over(before), F.lit(0).cast("bigint"))
    shown = F.greatest(F.least((F.col("poc") - F.col("i")) * delta, F.lit(2**31 - 1)), F.lit(-(2**31)))
    return rows.select(*keys, "i", at.alias("base_offset"), (at + F.col("base_size")).alias("enhancement_offset"), shown.alias("composition"))


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind.encode()) + body


def full(kind: str, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _table(kind: str, rows: Sequence[bytes], version: int = 0) -> bytes:
    return full(kind, struct.pack(">I", len(rows)), *rows, version=version)


def _u32(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


def _stretches(values: Sequence[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for v in values:
        out.append((out.pop()[0] + 1, v) if out and out[-1][1] == v else (1, v))
    return out


def _track(number: int, kind: str, size: tuple[int, int], sizes: Sequence[int], offsets: Sequence[int], delta: int, shifts: Sequence[int] | None, colour: tuple[int, int, int, bool] | None) -> bytes:
    n, (w, h) = len(sizes), size
    length = n * delta
    extra = box("colr", b"nclx", struct.pack(">3HB", *colour[:3], colour[3] << 7)) if colour else b""
    rate = sum(sizes) * 8 * TIMESCALE // max(1, length)
    extra += box("btrt", _u32(max(sizes, default=0), rate, rate))
    entry = box(kind, b"\0" * 6, struct.pack(">H", 1), b"\0" * 16, struct.pack(">2H", w, h), _u32(0x480000, 0x480000, 0), struct.pack(">H", 1), b"\0" * 32, struct.pack(">Hh", 24, -1), extra)
    big = any(o >> 32 for o in offsets)
    parts = [full("stsd", _u32(1), entry), _table("stts", [_u32(n, delta)] if n else [])]
    if shifts is not None and len(shifts) == n:
        parts.append(_table("ctts", [struct.pack(">Ii", c, v) for c, v in _stretches(shifts)], version=1))
    parts += [_table("stsc", [_u32(1, 1, 1)] if n else []), full("stsz", _u32(0, n, *sizes))]
    parts.append(_table("co64" if big else "stco", [struct.pack(">Q" if big else ">I", o) for o in offsets]))
    handler = full("hdlr", _u32(0), b"vide", b"\0" * 12, b"VideoHandler\0")
    home = box("dinf", full("dref", _u32(1), full("url ", flags=1)))
    media = box("mdia", full("mdhd", _u32(0, 0, TIMESCALE, length), struct.pack(">2H", 0x55C4, 0)), handler, box("minf", full("vmhd", b"\0" * 8, flags=1), home, box("stbl", *parts)))
    head = full("tkhd", _u32(0, 0, number, 0, length, 0, 0), struct.pack(">4h", 0, 0, 0, 0), MATRIX, _u32(w << 16, h << 16), flags=3)
    edit = box("edts", full("elst", _u32(1, length, 0), struct.pack(">2h", 1, 0)))
    return box("trak", head, edit, media)


def colour_codes(primaries: str, transfer: str, matrix: str, full_range: bool = False) -> tuple[int, int, int, bool]:
    """Code points of colour names; 2 (unspecified) for unknown ones."""
    return PRIMARIES.get(primaries, 2), TRANSFERS.get(transfer, 2), MATRICES.get(matrix, 2), full_range


def header(base: Sequence[int], enhancement: Sequence[int], size: tuple[int, int], fps: tuple[int, int], pocs: Sequence[int] | None = None, colour: tuple[int, int, int, bool] | None = None) -> bytes:
    """All of the file before its media, for samples of these sizes in turns."""
    n = min(len(base), len(enhancement))
    delta = TIMESCALE * fps[1] // fps[0]
    shifts = [max(-(2**31), min(2**31 - 1, (p - i) * delta)) for i, p in enumerate(pocs)] if pocs is not None and len(pocs) == n else None
    begin = box("ftyp", b"isom", _u32(512), b"isomiso2mp41")
    total = sum(base[:n]) + sum(enhancement[:n])
    wide = total + 8 >= 1 << 32

    def movie(at: int) -> bytes:
        starts, places = at, ([], [])
        for pair in zip(base[:n], enhancement[:n]):
            for k, length in enumerate(pair):
                places[k].append(starts)
                starts += length
        head = full("mvhd", _u32(0, 0, TIMESCALE, n * delta, 0x10000), struct.pack(">H", 0x100), b"\0" * 10, MATRIX, b"\0" * 24, _u32(3))
        tracks = [_track(k + 1, kind, size, list(part[:n]), places[k], delta, shifts, colour) for k, (kind, part) in enumerate((("vvc1", base), ("lvc1", enhancement)))]
        return box("moov", head, *tracks)

    media = struct.pack(">I4sQ", 1, b"mdat", total + 16) if wide else struct.pack(">I4s", total + 8, b"mdat")
    at, before = len(begin) + len(movie(0)) + len(media), -1
    while at != before:  # places beyond 4 GB take wider tables, which move the places
        before, at = at, len(begin) + len(movie(at)) + len(media)
    return begin + movie(at) + media


def mux(base: Sequence[bytes], enhancement: Sequence[bytes], size: tuple[int, int], fps: tuple[int, int], pocs: Sequence[int] | None = None, colour: tuple[int, int, int, bool] | None = None) -> bytes:
    """The file of as many pairs as both have samples."""
    head = header([len(x) for x in base], [len(x) for x in enhancement], size, fps, pocs, colour)
    return head + b"".join(x for pair in zip(base, enhancement) for x in pair)


def write_mp4(samples: DataFrame, path: str, size: tuple[int, int], fps: tuple[int, int], colour: tuple[int, int, int, bool] | None = None) -> int:
    """One file of (i, poc, base, enhancement) rows in order of ``i``; the driver holds sizes, and a partition of media at a time."""
    from .video import write_ordered

    sizes = sorted(samples.select("i", "poc", F.octet_length("base").alias("b"), F.octet_length("enhancement").alias("e")).collect())
    head = header([r.b for r in sizes], [r.e for r in sizes], size, fps, [r.poc for r in sizes], colour)
    return write_ordered(samples.select("i", F.concat("base", "enhancement").alias("data")), "i", path, head)


def boxes(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[str, int, int]]:
    """(kind, start of body, end) of the boxes in a stretch of a file."""
    out, end = [], len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        out.append((kind.decode("latin1"), at + 8, at + size))
        at += size
    return out
