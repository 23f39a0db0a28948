"""Frames at row grain: (frame_idx, plane, y, vals), a row of samples an array.

A plan over rows moves one key for a whole row where one over samples moves one
for each sample; joins of two signals become ``zip_with``.  Horizontal work needs
no exchange at all, vertical work one by plane or by pairs of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixedpoint import clamp, sat16, shr
from ..functions.transforms import names
from .stencil import _mix, average_row, upscale_row

FRAME = ["frame_idx", "plane"]
ROW = [*FRAME, "y"]
TU = [*FRAME, "tu_y", "tu_x"]


def map_rows(rows: DataFrame, f) -> DataFrame:
    """Every sample through ``f``."""
    return rows.select(*ROW, F.transform("vals", f).alias("vals"))


def _split(rows: DataFrame, size: int) -> DataFrame:
    """Rows that belong together (size after size) side by side: part, vals0.."""
    bits = size.bit_length() - 1
    at = F.col("y") % size
    return rows.groupBy(*FRAME, shr("y", bits).alias("part")).agg(*[F.max(F.when(at == k, F.col("vals"))).alias(f"vals{k}") for k in range(size)])


def downscale(rows: DataFrame, mode: str, depth: int) -> DataFrame:
    if mode == "0d":
        return rows
    peak = (1 << depth) - 1
    if mode == "1d":
        pair = lambda vals, x: (F.get(vals, 2 * x), F.get(vals, 2 * x + 1))
        half = F.sequence(F.lit(0), F.shiftright(F.size("vals") + 1, 1) - 1)
        box = lambda x: _box(pair(F.col("vals"), x), peak)
        return rows.select(*ROW, F.transform(half, box).alias("vals"))
    both = _split(rows, 2)
    low = F.coalesce("vals1", F.array().cast("array<bigint>"))
    half = F.sequence(F.lit(0), F.shiftright(F.size("vals0") + 1, 1) - 1)
    cells = lambda x: (F.get("vals0", 2 * x), F.get("vals0", 2 * x + 1), F.get(low, 2 * x), F.get(low, 2 * x + 1))
    return both.select(*FRAME, F.col("part").alias("y"), F.transform(half, lambda x: _box(cells(x), peak)).alias("vals"))


def _box(cells: tuple[Column, ...], peak: int) -> Column:
    """Rounded mean of the samples that are there."""
    zero = F.lit(0).cast("bigint")
    total = sum((F.coalesce(c, zero) for c in cells[1:]), cells[0])
    n = sum((F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0)) for c in cells[1:]), F.lit(1)).cast("bigint")
    return clamp(F.call_function("div", total + F.shiftright(n, 1), n), 0, peak)


def upscale(rows: DataFrame, mode: str, kernel: tuple[int, ...], average: bool) -> DataFrame:
    if mode == "0d":
        return rows
    if mode == "1d":
        up = average_row if average else upscale_row
        return rows.select(*ROW, up(F.col("vals"), kernel).alias("vals"))
    w = Window.partitionBy(*FRAME).orderBy("y")
    k0, k1, k2, k3 = kernel
    around = rows.select(*ROW, F.col("vals").alias("c"), F.lag("vals", 1).over(w).alias("u1"), F.lag("vals", 2).over(w).alias("u2"), F.lead("vals", 1).over(w).alias("d1"), F.lead("vals", 2).over(w).alias("d2"))
    around = around.select(*ROW, "c", F.coalesce("u1", "c").alias("a"), F.coalesce("u2", "u1", "c").alias("aa"), F.coalesce("d1", "c").alias("b"), F.coalesce("d2", "d1", "c").alias("bb"))
    aa, a, c, b, bb = (F.col(n) for n in ("aa", "a", "c", "b", "bb"))
    wide = around.select(*ROW, "c", _mix([aa, a, c, b], [k3, k2, k1, k0]).alias("top"), _mix([a, c, b, bb], [k0, k1, k2, k3]).alias("low"))
    wide = wide.select(*ROW, "c", upscale_row(F.col("top"), kernel).alias("top"), upscale_row(F.col("low"), kernel).alias("low"))
    if average:
        four = lambda i: F.get("top", 2 * i) + F.get("top", 2 * i + 1) + F.get("low", 2 * i) + F.get("low", 2 * i + 1)
        wide = wide.select(*ROW, "top", "low", F.transform("c", lambda v, i: v - shr(four(i) + 2, 2)).alias("shift"))
        moved = lambda n: F.transform(n, lambda u, i: sat16(u + F.get("shift", F.shiftright(i, 1)))).alias(n)
        wide = wide.select(*ROW, moved("top"), moved("low"))
    both = wide.select(*FRAME, "y", F.posexplode(F.array("top", "low")).alias("odd", "vals"))
    return both.select(*FRAME, (F.col("y") * 2 + F.col("odd")).alias("y"), "vals")


def _zipped(a: DataFrame, b: DataFrame, f) -> DataFrame:
    both = a.join(b.withColumnRenamed("vals", "more"), ROW)
    return both.select(*ROW, F.zip_with("vals", "more", f).alias("vals"))


def residual(target: DataFrame, prediction: DataFrame) -> DataFrame:
    return _zipped(target, prediction, lambda v, p: sat16(v - p))


def add(prediction: DataFrame, change: DataFrame) -> DataFrame:
    return _zipped(prediction, change, lambda p, r: sat16(p + r))


def _places(size: int) -> list[tuple[int, int]]:
    """(x, y) inside a block of each residual place."""
    if size == 2:
        return [(k & 1, k >> 1) for k in range(4)]
    return [(k & 1 | (k >> 2 & 1) << 1, k >> 1 & 1 | (k >> 3 & 1) << 1) for k in range(16)]


def gather(rows: DataFrame, size: int, prefix: str = "r") -> DataFrame:
    """Blocks with residual columns: rows of a block line meet, then are cut."""
    lines = _split(rows, size)
    cell = lambda b: F.struct(*[F.get(f"vals{y}", b * size + x).alias(f"{prefix}{k}") for k, (x, y) in enumerate(_places(size))])
    across = F.sequence(F.lit(0), F.call_function("div", F.size("vals0"), F.lit(size)).cast("int") - 1)
    cut = lines.select(*FRAME, F.col("part").alias("tu_y"), F.posexplode(F.transform(across, cell)).alias("tu_x", "s"))
    return cut.select(*FRAME, "tu_y", F.col("tu_x").cast("bigint").alias("tu_x"), "s.*")


def scatter(blocks: DataFrame, size: int, prefix: str) -> DataFrame:
    """Dense blocks back to rows."""
    cells = names(prefix, size)
    line = blocks.groupBy(*FRAME, "tu_y").agg(F.array_sort(F.collect_list(F.struct("tu_x", *cells))).alias("line"))
    by_place = {place: k for k, place in enumerate(_places(size))}

    def part(y: int):
        return lambda s: F.array(*[s[f"{prefix}{by_place[x, y]}"].cast("bigint") for x in range(size)])

    rows = [F.flatten(F.transform("line", part(y))) for y in range(size)]
    each = line.select(*FRAME, "tu_y", F.posexplode(F.array(*rows)).alias("at", "vals"))
    return each.select(*FRAME, (F.col("tu_y") * size + F.col("at")).alias("y"), "vals")


def block_places(rows: DataFrame, size: int) -> DataFrame:
    """(frame_idx, plane, tu_y, tu_x) of all blocks of frames."""
    tops = rows.where(F.col("y") % size == 0)
    across = F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.size("vals"), F.lit(size)) - 1)
    return tops.select(*FRAME, shr("y", size.bit_length() - 1).alias("tu_y"), F.explode(across).alias("tu_x"))
