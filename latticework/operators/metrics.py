"""Distortion and rate figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

KEY = ["frame_idx", "plane", "y", "x"]


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both signals at the same places, as v and w."""
    return a.join(b.withColumnRenamed("v", "w"), KEY)


def squared_error(pairs: DataFrame, by: list[str]) -> DataFrame:
    d = F.col("v") - F.col("w")
    return pairs.groupBy(*by).agg(F.sum(d * d).cast("bigint").alias("sse"), F.count("*").alias("n"), F.max(F.abs(d)).alias("max_diff"))


def psnr(peak: int):
    """Decibels of (sse, n); no error is infinite."""
    ratio = F.lit(float(peak * peak)) * F.col("n") / F.col("sse")
    return F.when(F.col("sse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(ratio))


def frame_psnr(pairs: DataFrame, depth: int) -> DataFrame:
    """(frame_idx, plane, sse, n, psnr) with subtotals: null plane for a frame, null frame for the stream."""
    d = F.col("v") - F.col("w")
    out = pairs.rollup("frame_idx", "plane").agg(F.sum(d * d).cast("bigint").alias("sse"), F.count("*").alias("n"))
    return out.withColumn("psnr", F.round(psnr((1 << depth) - 1), 6))


def first_difference(pairs: DataFrame) -> DataFrame:
    """(frame_idx, plane, max_diff, first_y, first_x): the largest difference and where the first one is."""
    d = F.abs(F.col("v") - F.col("w"))
    place = F.min(F.when(d != 0, F.struct("y", "x")))
    return pairs.groupBy("frame_idx", "plane").agg(F.max(d).alias("max_diff"), place.alias("p")).select("frame_idx", "plane", "max_diff", F.col("p.y").alias("first_y"), F.col("p.x").alias("first_x"))


def layer_energy(coefficients: DataFrame, denom: int) -> DataFrame:
    """(frame_idx, plane, layer, energy) of numerators over ``denom``: an integer sum divided once."""
    total = F.sum(F.col("c") * F.col("c")).cast("bigint")
    return coefficients.groupBy("frame_idx", "plane", "layer").agg(total.alias("square_sum")).withColumn("energy", F.col("square_sum") / float(denom * denom))


def symbol_histogram(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by context and byte of (ctx, byte) rows."""
    return symbols.groupBy(*keys, "ctx", "byte").agg(F.count("*").alias("n"))


def watched(frames: DataFrame, name: str = "coding") -> tuple[DataFrame, Observation]:
    """Coded frames (bytes, sse, dropped) that report totals while some action runs over them."""
    seen = Observation(name)
    return frames.observe(seen, F.count("*").alias("frames"), F.sum("bytes").alias("bytes"), F.sum("sse").alias("sse"), F.sum(F.col("dropped").cast("bigint")).alias("dropped")), seen


def row_error(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, sse, n, max_diff) of two signals at row grain (frame_idx, plane, y, vals): one key a row moves."""
    keys = ["frame_idx", "plane", "y"]
    apart = a.join(b.withColumnRenamed("vals", "_other"), keys).select(*keys, F.zip_with("vals", "_other", lambda p, q: F.abs(p - q)).alias("d"))
    square = F.aggregate("d", F.lit(0).cast("bigint"), lambda s, x: s + x * x)
    return apart.groupBy(*by).agg(F.sum(square).alias("sse"), F.sum(F.size("d")).cast("bigint").alias("n"), F.max(F.array_max("d")).alias("max_diff"))
