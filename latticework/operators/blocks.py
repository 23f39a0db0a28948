"""Samples as transform blocks, block orders and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blockmath import CORNERS, SIDES
from ..functions.fixedpoint import col, residual_index, sat16, shr
from ..functions.transforms import columns, forward, inverse, names

FRAME = ["frame_idx", "plane"]
TU = [*FRAME, "tu_y", "tu_x"]
BLOCK = 32


def gather(samples: DataFrame, size: int) -> DataFrame:
    """One row a block with its residual in columns r0.. (a partial aggregate, no lists)."""
    bits = size.bit_length() - 1
    placed = samples.select(*FRAME, shr("y", bits).alias("tu_y"), shr("x", bits).alias("tu_x"), residual_index("x", "y", size).alias("k"), "v")
    return placed.groupBy(*TU).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(n) for k, n in enumerate(names("r", size))])


def scatter(blocks: DataFrame, size: int, prefix: str = "r") -> DataFrame:
    """Blocks back to samples."""
    bits, cells = size.bit_length() - 1, []
    for k, n in enumerate(names(prefix, size)):
        x, y = (k & 1, k >> 1) if size == 2 else ((k & 1) | (k >> 2 & 1) << 1, (k >> 1 & 1) | (k >> 3 & 1) << 1)
        cells.append(F.struct((F.col("tu_y") * (1 << bits) + y).alias("y"), (F.col("tu_x") * (1 << bits) + x).alias("x"), F.col(n).cast("bigint").alias("v")))
    return blocks.select(*FRAME, F.explode(F.array(*cells)).alias("s")).select(*FRAME, "s.y", "s.x", "s.v")


def long_form(blocks: DataFrame, prefix: str, size: int, name: str) -> DataFrame:
    """(block, layer, value) rows of the columns prefix0.."""
    cells = F.array(*[F.struct(F.lit(k).cast("bigint").alias("layer"), F.col(n).cast("bigint").alias(name)) for k, n in enumerate(names(prefix, size))])
    return blocks.select(*TU, F.explode(cells).alias("s")).select(*TU, "s.layer", f"s.{name}")


def transform(blocks: DataFrame, size: int, line: bool = False) -> DataFrame:
    """Adds coefficient numerators c0.."""
    out = forward(columns("r", size), size, line)
    return blocks.select("*", *[c.alias(n) for c, n in zip(out, names("c", size))])


def restore(blocks: DataFrame, size: int, line: bool = False, prefix: str = "d", out: str = "i") -> DataFrame:
    """Adds the inverse transform of prefix0.. as out0.."""
    back = inverse(columns(prefix, size), size, line)
    return blocks.select("*", *[c.alias(n) for c, n in zip(back, names(out, size))])


def soften(blocks: DataFrame, corner: int, side: int, prefix: str = "r", out: str = "f") -> DataFrame:
    """Adds out0..: a 4x4 block with corners scaled by (16 - corner) / 16 and sides by (16 - side) / 16."""
    scale = dict.fromkeys(CORNERS, 16 - corner) | dict.fromkeys(SIDES, 16 - side)
    cells = [sat16(shr(F.col(n) * scale[k], 4)) if k in scale else F.col(n) for k, n in enumerate(names(prefix, 4))]
    return blocks.select("*", *[c.alias(n) for c, n in zip(cells, names(out, 4))])


def raster_order(tu_x: Column, tu_y: Column, across: int) -> Column:
    return col(tu_y) * across + col(tu_x)


def block_order(tu_x: Column, tu_y: Column, width: int, height: int, size: int) -> Column:
    """Index of a block when 32x32 areas are walked one after the other, edge areas cropped."""
    per = BLOCK // size
    across, down = width // size, height // size
    bx, by = F.floor(tu_x / per).cast("bigint"), F.floor(tu_y / per).cast("bigint")
    wide = F.when(bx < across // per, F.lit(per)).otherwise(F.lit(across % per)).cast("bigint")
    high = F.when(by < down // per, F.lit(per)).otherwise(F.lit(down % per)).cast("bigint")
    return by * (per * across) + bx * per * high + (col(tu_y) - by * per) * wide + (col(tu_x) - bx * per)


def tile_of(y: Column, x: Column, width: int, tile_width: int, tile_height: int) -> Column:
    across = -(-width // tile_width)
    return F.floor(y / tile_height).cast("bigint") * across + F.floor(x / tile_width).cast("bigint")
