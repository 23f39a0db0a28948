"""Raw and Y4M video files as frames of samples, and back.

A reader splits a file by frame ranges: each task seeks to its frames, so a file
is never one task's memory.  Paths go through Arrow's file systems (local paths,
or any URI they know).  Planes come out as rows of arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER_MOST = 1 << 16
MARK = b"FRAME\n"
PLANES = "frame_idx bigint, plane bigint, width bigint, height bigint, depth bigint, data array<int>"
#: Accepted chroma tags and their depths (fixed values).
CHROMA_TAGS = {"420jpeg": 8, "420p8": 8, "420": 8, "420p10": 10}


@dataclass(frozen=True)
class Layout:
    """Where frames lie in a file."""

    width: int
    height: int
    depth: int
    start: int = 0
    marker: int = 0
    fps: tuple[int, int] = (25, 1)

    @property
    def sample_bytes(self) -> int:
        return 2 if self.depth > 8 else 1

    @property
    def planes(self) -> list[tuple[int, int]]:
        half = ((self.width + 1) // 2, (self.height + 1) // 2)
        return [(self.width, self.height), half, half]

    @property
    def frame_bytes(self) -> int:
        return self.marker + self.sample_bytes * sum(w * h for w, h in self.planes)


def parse_y4m(head: bytes) -> Layout:
    """Layout from the first line of a Y4M file."""
    end = head.find(b"\n", 0, HEADER_MOST)
    if not head.startswith(b"YUV4MPEG2") or end < 0:
        raise ValueError("no Y4M header")
    fields = {t[:1]: t[1:] for t in head[9:end].decode("ascii").split() if t}
    tag = fields.get("C", "420jpeg")
    if tag not in CHROMA_TAGS:
        raise ValueError(f"chroma {tag} is not supported")
    rate = re.fullmatch(r"(\d+):(\d+)", fields.get("F", ""))
    if not rate or "W" not in fields or "H" not in fields:
        raise ValueError("the header lacks size or rate")
    return Layout(int(fields["W"]), int(fields["H"]), CHROMA_TAGS[tag], end + 1, len(MARK), (int(rate[1]), int(rate[2]) or 1))


def _open(path: str):
    fs, inside = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(inside)


def layout_of(options: dict[str, str]) -> tuple[Layout, int]:
    """Layout and frame count of the file in ``path``: Y4M by its first bytes, else raw of the given size."""
    with _open(options["path"]) as f:
        head, size = f.read(HEADER_MOST), f.size()
    given = options.get("format", "auto")
    if given == "y4m" or given == "auto" and head[:9] == b"YUV4MPEG2":
        layout = parse_y4m(head)
    else:
        depth = int(options.get("depth", 8))
        if depth not in (8, 10):
            raise ValueError("the depth must be 8 or 10")
        layout = Layout(int(options["width"]), int(options["height"]), depth)
    body = size - layout.start
    if body % layout.frame_bytes:
        raise ValueError("truncated frame")
    return layout, body // layout.frame_bytes


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.layout, self.frames = layout_of(options)
        limit = options.get("frames")
        self.frames = min(self.frames, int(limit)) if limit else self.frames
        self.out_depth = int(options.get("outdepth", self.layout.depth))
        if self.out_depth > self.layout.depth:
            raise ValueError("samples are not widened")

    def partitions(self) -> list[InputPartition]:
        per = max(1, int(self.options.get("framespertask", max(1, (64 << 20) // self.layout.frame_bytes))))
        return [_Range(k, min(k + per, self.frames)) for k in range(0, self.frames, per)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        lay = self.layout
        with _open(self.options["path"]) as f:
            for k in range(part.first, part.last):
                f.seek(lay.start + k * lay.frame_bytes)
                raw = f.read(lay.frame_bytes)
                if raw[: lay.marker] != MARK[: lay.marker]:
                    raise ValueError(f"frame {k} has no marker")
                at = lay.marker
                for plane, (w, h) in enumerate(lay.planes):
                    data = np.frombuffer(raw, "<u2" if lay.sample_bytes == 2 else "u1", w * h, at).astype(np.int32)
                    at += w * h * lay.sample_bytes
                    yield k, plane, w, h, self.out_depth, (data >> lay.depth - self.out_depth).tolist()


class VideoSource(DataSource):
    """``spark.read.format("lattice_video").load(path)``; options width, height, depth, format, frames, outDepth."""

    @classmethod
    def name(cls) -> str:
        return "lattice_video"

    def schema(self) -> str:
        return PLANES

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_video(spark: SparkSession, path: str, **options) -> DataFrame:
    """Planes of a video file."""
    spark.dataSource.register(VideoSource)
    return spark.read.format("lattice_video").options(**{k: str(v) for k, v in options.items()}).load(path)


def to_samples(planes: DataFrame) -> DataFrame:
    """Planes as (frame_idx, plane, y, x, v)."""
    each = planes.select("frame_idx", "plane", "width", F.posexplode("data").alias("i", "v"))
    div = F.call_function("div", F.col("i"), F.col("width"))
    return each.select("frame_idx", "plane", div.cast("bigint").alias("y"), (F.col("i") % F.col("width")).cast("bigint").alias("x"), F.col("v").cast("bigint").alias("v"))


def to_planes(samples: DataFrame, depth: int) -> DataFrame:
    """Samples back to planes: rows first, so only one plane meets in a task."""
    rows = samples.groupBy("frame_idx", "plane", "y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("s"))
    rows = rows.select("frame_idx", "plane", "y", F.transform("s", lambda s: s["v"].cast("int")).alias("row"))
    whole = rows.groupBy("frame_idx", "plane").agg(F.array_sort(F.collect_list(F.struct("y", "row"))).alias("rows"))
    data = F.flatten(F.transform("rows", lambda r: r["row"]))
    return whole.select("frame_idx", "plane", F.size(F.get("rows", 0)["row"]).cast("bigint").alias("width"), F.size("rows").cast("bigint").alias("height"), F.lit(depth).cast("bigint").alias("depth"), data.alias("data"))


def frame_bytes(planes: DataFrame) -> DataFrame:
    """(frame_idx, data): raw bytes of each frame, planes in order."""
    whole = planes.groupBy("frame_idx").agg(F.array_sort(F.collect_list(F.struct("plane", "depth", "data"))).alias("p"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [b"".join(np.array(p["data"], "<u2" if p["depth"] > 8 else "u1").tobytes() for p in row) for row in batch.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("frame_idx"), pa.array(out, pa.binary())], names=["frame_idx", "data"])

    return whole.mapInArrow(run, "frame_idx bigint, data binary")


def write_ordered(rows: DataFrame, order: str, path: str, head: bytes = b"", before: bytes = b"") -> int:
    """One file of the ``data`` of all rows in ``order``; a file is written by one writer, row by row."""
    fs, inside = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    written = 0
    with fs.open_output_stream(inside) as out:
        out.write(head)
        for row in rows.select(order, "data").orderBy(order).toLocalIterator(prefetchPartitions=True):
            out.write(before + bytes(row["data"]))
            written += 1
    return written


def write_yuv(planes: DataFrame, path: str) -> int:
    return write_ordered(frame_bytes(planes), "frame_idx", path)


def write_y4m(planes: DataFrame, path: str, layout: Layout) -> int:
    tag = "420p10" if layout.depth == 10 else "420jpeg"
    head = f"YUV4MPEG2 W{layout.width} H{layout.height} F{layout.fps[0]}:{layout.fps[1]} C{tag}\n".encode()
    return write_ordered(frame_bytes(planes), "frame_idx", path, head, MARK)
