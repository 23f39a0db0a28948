"""Driver tables as frames of samples: (frame_idx, plane, y, x, v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixedpoint import clamp
from ..session import table


def _long(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as 16x16 frames of depth 10; the last frame is filled up with zeros."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    last = events.agg(F.max("event_id")).first()[0]
    if last is not None:
        events = events.union(spark.range(last + 1, (last // 256 + 1) * 256).select(F.col("id").alias("event_id"), F.lit(0.0).alias("value")))
    e = F.col("event_id")
    v = clamp(F.floor(F.coalesce("value", F.lit(0.0))), 0, 1023)
    rows = events.select(F.call_function("div", e, F.lit(256)).alias("frame_idx"), F.lit(0).alias("plane"), F.call_function("div", e % 256, F.lit(16)).alias("y"), (e % 16).alias("x"), v.alias("v"))
    return rows.select(*_long("frame_idx", "plane", "y", "x", "v"))


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8x8 frames of depth 8."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_idx"), F.posexplode("embedding").alias("i", "e"))
    v = clamp(F.floor(F.col("e").cast("double") * 256) + 128, 0, 255)
    rows = rows.select("frame_idx", F.lit(0).alias("plane"), F.shiftright("i", 3).alias("y"), (F.col("i") % 8).alias("x"), v.alias("v"))
    return rows.select(*_long("frame_idx", "plane", "y", "x", "v"))


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames as rows that are arrays: (frame_idx, plane, y, vals), cut from the vectors without an exchange."""
    v = F.transform("embedding", lambda e: clamp(F.floor(e.cast("double") * 256) + 128, 0, 255).cast("bigint"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("v", y * 8 + 1, F.lit(8)))
    cut = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_idx"), v.alias("v")).select("frame_idx", F.posexplode(rows).alias("y", "vals"))
    return cut.select("frame_idx", F.lit(0).cast("bigint").alias("plane"), F.col("y").cast("bigint").alias("y"), "vals")


def count_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by supplier and part modulo 64, counted modulo 256, as one 64x64 frame of depth 8."""
    found = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 64).alias("y"), (F.col("l_partkey") % 64).alias("x")).agg(F.count("*").alias("n"))
    places = spark.range(64 * 64).select(F.shiftright("id", 6).alias("y"), (F.col("id") % 64).alias("x"))
    rows = places.join(found, ["y", "x"], "left").select(F.lit(0).alias("frame_idx"), F.lit(0).alias("plane"), "y", "x", (F.coalesce("n", F.lit(0)) % 256).alias("v"))
    return rows.select(*_long("frame_idx", "plane", "y", "x", "v"))


def user_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of each user's events in order: (user_id, i, v), many of them zero."""
    events = table(spark, sf_dir, "events")
    v = F.greatest(F.floor((F.col("value") - 60) / 40), F.lit(0)).cast("bigint")
    signed = F.when(F.col("event_id") % 3 == 0, -v).otherwise(v)
    return events.select("user_id", F.col("event_id").alias("i"), signed.alias("v"))


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte values of document texts with their counts by document: (doc_id, byte, n).

    Bytes are counted inside each Arrow batch, so no row is made of a single byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column("doc_id").to_pylist(), [np.bincount(np.frombuffer((t or "").encode(), np.uint8), minlength=256) for t in batch.column("text").to_pylist()]
            row, byte = np.nonzero(np.array(found).reshape(-1, 256))
            counts = np.array([found[r][b] for r, b in zip(row, byte)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in row], pa.int64()), pa.array(byte.astype(np.int64)), pa.array(counts)], names=["doc_id", "byte", "n"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id bigint, byte bigint, n bigint")


def event_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event frames as three planes of a 4:2:0 picture: the values, and two half-size planes of every second one."""
    luma = event_frames(spark, sf_dir)
    half = luma.where("y % 2 = 0 and x % 2 = 0")
    small = lambda p, v: half.select("frame_idx", F.lit(p).cast("bigint").alias("plane"), F.shiftright("y", 1).alias("y"), F.shiftright("x", 1).alias("x"), v.alias("v"))
    return luma.union(small(1, F.col("v") % 512)).union(small(2, 1023 - F.col("v")))
