"""Quantization: step tables, dead-zone levels, rate-distortion choice, reconstruction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixedpoint import ColumnLike, clamp, col, sat16, shr

#: Fixed values of the dequantization rule.
A, B, C, D = 39, 126484, 5242, 99614
STEP_MIN, STEP_MAX = 1, 32767
MATRIX_SCALE_MAX = 3 << 16
DEADZONE_STEP_LIMIT = 12249
INTER, INTRA = 0, 1

#: Default quantization matrices by (transform size, one-dimensional, level), fixed values.
DEFAULT_MATRIX = {
    (2, True, 0): (0, 2, 0, 0),
    (2, True, 1): (0, 3, 0, 32),
    (2, False, 0): (32, 3, 0, 32),
    (2, False, 1): (0, 3, 0, 32),
    (4, True, 0): (13, 26, 19, 32, 52, 1, 78, 9, 13, 26, 19, 32, 150, 91, 91, 19),
    (4, True, 1): (0, 0, 0, 2, 52, 1, 78, 9, 26, 72, 0, 3, 150, 91, 91, 19),
    (4, False, 0): (13, 26, 19, 32, 52, 1, 78, 9, 26, 72, 0, 3, 150, 91, 91, 19),
    (4, False, 1): (0, 0, 0, 2, 52, 1, 78, 9, 26, 72, 0, 3, 150, 91, 91, 19),
}


def log_fixed(x: Column) -> Column:
    """Natural logarithm cut to 12 fractional bits."""
    ln = F.log(x.cast("double"))
    return F.floor(ln) + F.floor((ln - F.floor(ln)) * 4096.0) / 4096.0


def temporal_step(modifier: ColumnLike, step: ColumnLike) -> Column:
    """Step of inter-predicted blocks: reduced by modifier / 255, at most by half."""
    cut = F.least(col(modifier) * 257, F.lit(1 << 15).cast("bigint"))
    return clamp(shr((F.lit(1 << 16).cast("bigint") - cut) * col(step), 16), STEP_MIN, STEP_MAX)


def layer_step(matrix: ColumnLike, step: ColumnLike) -> Column:
    scaled = clamp(col(matrix) * col(step) + (1 << 16), 0, MATRIX_SCALE_MAX)
    base = clamp(shr(scaled * col(step), 16), STEP_MIN, STEP_MAX)
    extra = _toward_zero(F.lit(float(D)) - F.lit(float(C)) * log_fixed(base))
    power = extra * base * base
    return clamp(base + F.when(power >= 0, shr(power, 31)).otherwise(-shr(-power, 31)), STEP_MIN, STEP_MAX)


def _toward_zero(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("bigint")


def deadzone(step: ColumnLike, layer: ColumnLike) -> Column:
    """Width of the dead zone of a layer under its plane's step."""
    layer = col(layer)
    scaled = F.lit(1 << 16).cast("bigint") - shr(layer * A + B, 1)
    return F.when(col(step) <= 16, shr(step, 1)).when(layer > DEADZONE_STEP_LIMIT, F.lit(2**31 - 1).cast("bigint")).otherwise(shr(scaled * layer, 16))


def offset_of(zone: Column) -> Column:
    """The applied offset: the negated dead zone, cut to 16 bits as stored."""
    low = F.pmod(-zone, F.lit(1 << 16).cast("bigint"))
    return F.when(low >= 1 << 15, low - (1 << 16)).otherwise(low)


def step_table(layers: DataFrame, temporal: bool, top_level: bool, refresh: bool, modifier: int = 48) -> DataFrame:
    """Adds step_width, deadzone and offset to (step, signal, layer, matrix) rows."""
    base = clamp("step", STEP_MIN, STEP_MAX)
    if temporal and top_level and not refresh:
        base = F.when(F.col("signal") == INTER, temporal_step(modifier, base)).otherwise(base)
    out = layers.withColumn("plane_step", base)
    out = out.withColumn("step_width", layer_step("matrix", "plane_step"))
    out = out.withColumn("deadzone", deadzone("plane_step", "step_width"))
    return out.withColumn("offset", offset_of(F.col("deadzone")))


def matrix_rows(spark: SparkSession, steps: list[int], matrix: tuple[int, ...]) -> DataFrame:
    """(step, signal, layer, matrix) for the given steps: a table of constants."""
    rows = [(s, t, k, m) for s in steps for t in (INTER, INTRA) for k, m in enumerate(matrix)]
    return spark.createDataFrame(rows, "step bigint, signal bigint, layer bigint, matrix bigint")


# The same rule for one step on the driver, for plans that need its numbers as literals.


def plane_step(step: int, plane: int, top_level: bool, multiplier: int) -> int:
    """Step of a plane, as ``fixedpoint.step_of_plane``."""
    return max(STEP_MIN, min(STEP_MAX, step * multiplier >> 6 if plane > 0 and top_level else step))


def table_for(step: int, matrix: tuple[int, ...], temporal: bool = False, top_level: bool = True, refresh: bool = False, modifier: int = 48) -> dict[int, list[tuple[int, int, int]]]:
    """signal -> [(step_width, offset, deadzone)] by layer."""

    def bound(x: int) -> int:
        return max(STEP_MIN, min(STEP_MAX, x))

    def log12(x: int) -> float:
        ln = math.log(x)
        return math.floor(ln) + math.floor((ln - math.floor(ln)) * 4096) / 4096

    out = {}
    for signal in (INTER, INTRA):
        plane = bound(step)
        if signal == INTER and temporal and top_level and not refresh:
            plane = bound(((1 << 16) - min(modifier * 257, 1 << 15)) * plane >> 16)
        row = []
        for m in matrix:
            w = bound(max(0, min(MATRIX_SCALE_MAX, m * plane + (1 << 16))) * plane >> 16)
            w = bound(w + int(int(D - C * log12(w)) * w * w / (1 << 31)))
            if plane <= 16:
                zone = plane >> 1
            elif w > DEADZONE_STEP_LIMIT:
                zone = 2**31 - 1
            else:
                zone = ((1 << 16) - (A * w + B >> 1)) * w >> 16
            low = -zone & 0xFFFF
            row.append((w, low - (1 << 16) if low >= 1 << 15 else low, zone))
        out[signal] = row
    return out


def of_layer(table: list[tuple[int, int, int]], layer: ColumnLike) -> tuple[Column, Column, Column]:
    """Step width, offset and dead zone of a layer of ``table_for``, as a lookup in constant arrays."""
    at = (col(layer) + 1).cast("int")
    return tuple(F.element_at(F.array(*[F.lit(x).cast("bigint") for x in part]), at) for part in zip(*table))


def quantize(num: ColumnLike, denom: int, step: ColumnLike, zone: ColumnLike) -> Column:
    """Level of the coefficient num / denom: nearest under the dead zone, away from zero."""
    num, step = col(num), col(step)
    top = F.abs(num) * 2 + F.abs(col(zone) * 2 + step) * denom
    level = _div(top, step * (2 * denom))
    return F.when(num == 0, F.lit(0).cast("bigint")).otherwise(clamp(F.when(num < 0, -level).otherwise(level), -8192, 8191))


def _div(a: Column, b: Column) -> Column:
    """Integer quotient of non-negative values."""
    return F.call_function("div", a, b)


def dequantize(level: ColumnLike, step: ColumnLike, offset: ColumnLike) -> Column:
    level = col(level)
    value = F.when(level > 0, level * col(step) + col(offset)).when(level < 0, level * col(step) - col(offset)).otherwise(F.lit(0).cast("bigint"))
    return sat16(value)


def choose_level(num: ColumnLike, denom: int, level: ColumnLike, step: ColumnLike, offset: ColumnLike, lambda_div: int = 16) -> Column:
    """Of the neighbouring levels (and 0 for small ones) the one of least distortion plus rate.

    Costs use the true square of the error; ties go to the smaller candidate,
    and to 0 last.
    """
    num, level, step, offset = col(num), col(level), col(step), col(offset)
    rate = _div(step * step, F.lit(lambda_div).cast("bigint")) * (denom * denom)

    def cost(q: Column) -> Column:
        value = F.when(q > 0, q * step + offset).when(q < 0, q * step - offset).otherwise(F.lit(0).cast("bigint"))
        error = value * denom - num
        bits = F.when(q == 0, 0).when(F.abs(q) <= 32, 9).otherwise(17)
        return error * error + rate * bits

    tried = [F.struct(cost(level + d).alias("cost"), F.lit(k).alias("turn"), (level + d).alias("q")) for k, d in enumerate((-1, 0, 1))]
    zero = F.struct((num * num).alias("cost"), F.lit(3).alias("turn"), F.lit(0).cast("bigint").alias("q"))
    near = F.array_min(F.array(*tried))
    least = F.when(F.abs(level) <= 2, F.least(near, zero)).otherwise(near)["q"]
    settled = (level == 0) & (num * num <= rate * 9)
    return F.when(settled | (F.abs(level) > 4), level).otherwise(clamp(least, -8192, 8191))


def adapted_matrix(rows: DataFrame, keys: list[str], beta: float) -> DataFrame:
    """Matrix of the next frame from (keys, layer, energy, matrix): rescaled by energy over its geometric mean."""
    energy = F.greatest(F.col("energy").cast("double"), F.lit(1e-9))
    mean = rows.groupBy(*keys).agg(F.greatest(F.exp(F.avg(F.log(energy))), F.lit(1e-9)).alias("mean"))
    scaled = F.round(F.col("matrix") * F.pow(energy / F.col("mean"), F.lit(beta)))
    return rows.join(mean, keys).withColumn("adapted", clamp(F.least(F.greatest(scaled, F.lit(1.0)), F.lit(255.0)), 1, 255)).drop("mean")
