"""Resolution changes of frames at sample or row grain.

Rows are arrays, so the horizontal pass is an array function inside one row and
the vertical pass a window over few rows; a frame is never one task's array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixedpoint import clamp, col, sat15, sat16, shr

FRAME = ["frame_idx", "plane"]
#: Upsampling kernels (fixed values), in units of 1/16384.
KERNELS = {
    "nearest": (0, 16384, 0, 0),
    "linear": (0, 12288, 4096, 0),
    "cubic": (-1382, 14285, 3942, -461),
    "modified_cubic": (-2360, 15855, 4165, -1276),
}


def downscale(samples: DataFrame, mode: str, depth: int) -> DataFrame:
    """Half size by rounded box means of the samples in bounds; ``1d`` halves the width only, ``0d`` nothing."""
    if mode == "0d":
        return samples
    y = shr("y", 1) if mode == "2d" else F.col("y")
    boxes = samples.groupBy(*FRAME, y.alias("y"), shr("x", 1).alias("x")).agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    mean = F.call_function("div", F.col("s") + F.call_function("div", F.col("n"), F.lit(2)), F.col("n"))
    return boxes.select(*FRAME, "y", "x", clamp(mean, 0, (1 << depth) - 1).alias("v"))


def to_rows(samples: DataFrame) -> DataFrame:
    """(frame_idx, plane, y, vals): rows as arrays in x order."""
    packed = F.array_sort(F.collect_list(F.struct("x", "v")))
    return samples.groupBy(*FRAME, "y").agg(F.transform(packed, lambda s: s["v"]).alias("vals"))


def to_samples(rows: DataFrame) -> DataFrame:
    return rows.select(*FRAME, "y", F.posexplode("vals").alias("x", "v")).select(*FRAME, "y", F.col("x").cast("bigint").alias("x"), "v")


def _tap(vals: Column, i: Column) -> Column:
    return F.get(vals, F.greatest(F.lit(0), F.least(i, F.size(vals) - 1)))


def _round(total: Column) -> Column:
    return sat15(shr(total + 0x2000, 14))


def row_pairs(vals: Column, kernel: tuple[int, ...]) -> Column:
    """The two children of each sample of a row; edges repeat the outer sample."""
    k = [col(x) for x in kernel]

    def pair(x: Column) -> Column:
        even = sum((_tap(vals, x + d) * w for d, w in ((-1, k[2]), (0, k[1]), (1, k[0]))), _tap(vals, x - 2) * k[3])
        odd = sum((_tap(vals, x + d) * w for d, w in ((0, k[1]), (1, k[2]), (2, k[3]))), _tap(vals, x - 1) * k[0])
        return F.array(_round(even), _round(odd))

    return F.transform(F.sequence(F.lit(0), F.size(vals) - 1), pair)


def upscale_row(vals: Column, kernel: tuple[int, ...]) -> Column:
    """Twice the samples of a row."""
    return F.flatten(row_pairs(vals, kernel))


def average_row(vals: Column, kernel: tuple[int, ...]) -> Column:
    """Twice the samples of a row, each two children moved so that their mean is the sample."""

    def moved(v: Column, p: Column) -> Column:
        shift = v - shr(p[0] + p[1] + 1, 1)
        return F.array(sat16(p[0] + shift), sat16(p[1] + shift))

    return F.flatten(F.zip_with(vals, row_pairs(vals, kernel), moved))


def _mix(rows: list[Column], weights: list[int]) -> Column:
    """Weighted sum of up to four rows, element by element, rounded."""
    zipped = F.arrays_zip(*[r.alias(f"r{i}") for i, r in enumerate(rows)])
    return F.transform(zipped, lambda s: _round(sum((s[f"r{i}"] * w for i, w in enumerate(weights) if i), s["r0"] * weights[0])))


def upscale(samples: DataFrame, mode: str, kernel: tuple[int, ...], average: bool = False) -> DataFrame:
    """Double size; ``average`` shifts the children of a sample so that their mean is that sample."""
    if mode == "0d":
        return samples
    rows = to_rows(samples)
    if mode == "1d":
        up = average_row if average else upscale_row
        return to_samples(rows.select(*FRAME, "y", up(F.col("vals"), kernel).alias("vals")))
    w = Window.partitionBy(*FRAME).orderBy("y")
    near = {d: (F.lag("vals", -d).over(w) if d < 0 else F.lead("vals", d).over(w)) for d in (-2, -1, 1, 2)}
    around = rows.select(*FRAME, "y", F.col("vals").alias("c"), *[c.alias(f"n{d + 2}") for d, c in near.items()])
    up1, down1 = F.coalesce("n1", "c"), F.coalesce("n3", "c")
    up2, down2 = F.coalesce("n0", "n1", "c"), F.coalesce("n4", "n3", "c")
    k0, k1, k2, k3 = kernel
    halves = around.select(*FRAME, "y", "c", up1.alias("a"), down1.alias("b"), up2.alias("aa"), down2.alias("bb"))
    cols = {n: F.col(n) for n in ("aa", "a", "c", "b", "bb")}
    halves = halves.select(*FRAME, "y", "c", _mix([cols["aa"], cols["a"], cols["c"], cols["b"]], [k3, k2, k1, k0]).alias("top"), _mix([cols["a"], cols["c"], cols["b"], cols["bb"]], [k0, k1, k2, k3]).alias("low"))
    wide = halves.select(*FRAME, "y", "c", upscale_row(F.col("top"), kernel).alias("top"), upscale_row(F.col("low"), kernel).alias("low"))
    if average:
        four = lambda i: F.get("top", 2 * i) + F.get("top", 2 * i + 1) + F.get("low", 2 * i) + F.get("low", 2 * i + 1)
        wide = wide.select(*FRAME, "y", "top", "low", F.transform("c", lambda v, i: v - shr(four(i) + 2, 2)).alias("shift"))
        moved = lambda name: F.transform(name, lambda u, i: sat16(u + F.get("shift", F.shiftright(i, 1)))).alias(name)
        wide = wide.select(*FRAME, "y", moved("top"), moved("low"))
    both = wide.select(*FRAME, "y", F.posexplode(F.array("top", "low")).alias("odd", "vals"))
    return to_samples(both.select(*FRAME, (F.col("y") * 2 + F.col("odd")).alias("y"), "vals"))


def pad(samples: DataFrame, width: int, height: int, multiple: int = 16, fill: int = 512) -> DataFrame:
    """Frames enlarged to multiples of ``multiple``; new samples are ``fill``.

    New places are generated from the frames' keys, so nothing is joined.
    """
    wide, high = -(-width // multiple) * multiple, -(-height // multiple) * multiple
    if (wide, high) == (width, height):
        return samples
    frames = samples.where("y = 0 and x = 0").select(*FRAME)
    rows = frames.select(*FRAME, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(high - 1).cast("bigint"))).alias("y"))
    first = F.when(F.col("y") < height, F.lit(width)).otherwise(F.lit(0)).cast("bigint")
    some = rows.where(f"y >= {height} or {wide} > {width}")
    extra = some.select(*FRAME, "y", F.explode(F.sequence(first, F.lit(wide - 1).cast("bigint"))).alias("x"), F.lit(fill).cast("bigint").alias("v"))
    return samples.select(*FRAME, "y", "x", "v").union(extra)


def crop(samples: DataFrame, width: int, height: int) -> DataFrame:
    return samples.where((F.col("y") < height) & (F.col("x") < width))


def residual(target: DataFrame, prediction: DataFrame) -> DataFrame:
    """Saturated difference of two signals at the same places."""
    p = prediction.withColumnRenamed("v", "p")
    return target.join(p, [*FRAME, "y", "x"]).select(*FRAME, "y", "x", sat16(F.col("v") - F.col("p")).alias("v"))


def add(prediction: DataFrame, change: DataFrame) -> DataFrame:
    """Saturated sum of two signals; places without a change keep the prediction."""
    r = change.withColumnRenamed("v", "r")
    return prediction.join(r, [*FRAME, "y", "x"], "left").select(*FRAME, "y", "x", sat16(F.col("v") + F.coalesce("r", F.lit(0))).alias("v"))
