"""From file to file: video to units and base, and back.

A file is one stream, so coding walks its pictures in order in one task (see
``closed_loop``); reading and writing are spread and streamed around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import BaseCodec
from ..session import settle, share_code
from ..sources.annexb import units
from ..sources.container import write_mp4
from ..sources.video import frame_bytes, read_video, write_ordered
from . import closed_loop
from .config import StreamConfig


def pictures(planes: DataFrame) -> DataFrame:
    """(stream, frame_idx, data): planes of each frame end to end."""
    whole = planes.groupBy("frame_idx").agg(F.array_sort(F.collect_list(F.struct("plane", "data"))).alias("p"))
    return whole.select(F.lit(0).cast("long").alias("stream"), F.col("frame_idx").cast("long").alias("frame_idx"), F.flatten(F.transform("p", lambda p: p["data"])).alias("data"))


def _planes(frames: DataFrame, column: str, depth: int) -> DataFrame:
    """Whole frames as one plane a row, for the raw writers."""
    return frames.select("frame_idx", F.lit(0).alias("plane"), F.lit(depth).alias("depth"), F.col(column).alias("data"))


def encode_file(spark: SparkSession, source: str, units_path: str, cfg: StreamConfig, control: closed_loop.Control | None = None, base_codec: BaseCodec | None = None, base_path: str | None = None, decoded_path: str | None = None, mp4_path: str | None = None, fps: tuple[int, int] = (25, 1), **video) -> DataFrame:
    """Codes a video file into one file of units; also, if asked for, raw base and decoded frames and a two-track file.

    Returns a row of numbers a picture (``closed_loop.COLUMNS``); ``metrics.watched`` totals them.
    """
    share_code(spark)
    coded = settle(closed_loop.code_streams(pictures(read_video(spark, source, **video)), "stream", cfg.validate(), control, base_codec, stream=True))
    write_ordered(coded.select("frame_idx", F.col("unit").alias("data")), "frame_idx", units_path)
    for path, column, depth in ((base_path, "base", cfg.base_depth), (decoded_path, "output", cfg.depth)):
        if path:
            write_ordered(frame_bytes(_planes(coded, column, depth)), "frame_idx", path)
    if mp4_path:
        base = frame_bytes(_planes(coded, "base", cfg.base_depth)).withColumnRenamed("data", "base")
        both = base.join(coded.select("frame_idx", F.col("unit").alias("enhancement")), "frame_idx")
        write_mp4(both.select(F.col("frame_idx").alias("i"), F.col("frame_idx").alias("poc"), "base", "enhancement"), mp4_path, (cfg.width, cfg.height), fps)
    return coded.drop("unit", "base", "output")


def decode_file(spark: SparkSession, units_path: str, base_path: str, out_path: str, cfg: StreamConfig) -> int:
    """Decodes a file of units over a raw file of base frames into a raw file; returns how many frames."""
    share_code(spark)
    held = spark.read.format("binaryFile").load(units_path).select(F.lit(0).cast("long").alias("stream"), F.col("content").alias("data"))
    parts = units(held, "stream").select("stream", F.col("unit_idx").alias("frame_idx"), F.col("data").alias("unit"))
    w, h = cfg.size(2)
    base = pictures(read_video(spark, base_path, width=w, height=h, depth=cfg.base_depth)).withColumnRenamed("data", "base")
    out = closed_loop.decode_streams(parts.join(base, ["stream", "frame_idx"]), "stream", cfg)
    return write_ordered(frame_bytes(_planes(out, "data", cfg.depth)), "frame_idx", out_path)
