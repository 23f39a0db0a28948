"""Integer arithmetic of samples, as column expressions.

Everything stays in BIGINT and is clamped explicitly: with ANSI mode on, an
overflow would raise instead of wrapping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(x: ColumnLike | int) -> Column:
    return F.lit(x).cast("bigint") if isinstance(x, int) else (F.col(x) if isinstance(x, str) else x).cast("bigint")


def clamp(x: ColumnLike, low: int, high: int) -> Column:
    return F.greatest(F.lit(low).cast("bigint"), F.least(F.lit(high).cast("bigint"), col(x)))


def sat15(x: ColumnLike) -> Column:
    return clamp(x, -(1 << 14), (1 << 14) - 1)


def sat16(x: ColumnLike) -> Column:
    return clamp(x, -(1 << 15), (1 << 15) - 1)


def shr(x: ColumnLike, n: int) -> Column:
    """Arithmetic right shift."""
    return F.shiftright(col(x), n)


def to_internal(v: ColumnLike, depth: int) -> Column:
    """Unsigned sample of ``depth`` bits to the signed 15-bit working range."""
    return col(v) * (1 << 15 - depth) - (1 << 14)


def to_sample(s: ColumnLike, depth: int) -> Column:
    """Working range back to an unsigned sample, rounded and clamped."""
    scaled = shr(col(s) + (1 << 14 - depth), 15 - depth) + (1 << depth - 1)
    return clamp(scaled, 0, (1 << depth) - 1)


def residual_index(x: ColumnLike, y: ColumnLike, size: int) -> Column:
    """Place of a sample in its 2x2 or 4x4 block: bits of x and y interleaved."""
    x, y = col(x), col(y)
    low = x.bitwiseAND(1) + y.bitwiseAND(1) * 2
    return low if size == 2 else low + shr(x, 1).bitwiseAND(1) * 4 + shr(y, 1).bitwiseAND(1) * 8


def step_of_plane(step: ColumnLike, plane: ColumnLike, top_level: bool, chroma_multiplier: int) -> Column:
    """Step width of a plane; chroma of the top level scales by multiplier / 64."""
    scaled = shr(col(step) * chroma_multiplier, 6) if top_level else col(step)
    return clamp(F.when(col(plane) > 0, scaled).otherwise(col(step)), 1, 32767)


def level_band(samples_per_second: ColumnLike) -> Column:
    """Level by sample rate (fixed bounds of the standard's table)."""
    rate = col(samples_per_second)
    return F.when(rate <= 29_410_000, 1).when(rate <= 124_560_000, 2).when(rate <= 527_650_000, 3).otherwise(4).cast("bigint")


def seven_bit_groups(v: ColumnLike) -> Column:
    """Big-endian groups of seven bits, all but the last with the high bit set."""
    v = col(v)
    digits = F.when(v > 0, F.ceil(F.length(F.bin(v)) / 7)).otherwise(1).cast("int")
    down = F.sequence(digits - 1, F.lit(0))
    return F.transform(down, lambda g: F.call_function("shiftright", v.cast("bigint"), g * 7).bitwiseAND(127) + F.when(g > 0, 128).otherwise(0))


def value_symbols(v: ColumnLike) -> Column:
    """A level as context/byte pairs (context 0 low, 1 high byte); small levels take one byte."""
    v = col(v)
    pair = lambda ctx, b: F.struct(F.lit(ctx).cast("bigint").alias("ctx"), b.cast("bigint").alias("byte"))
    wide = v + 0x2000
    small = F.array(pair(0, (v + 32).bitwiseAND(63) * 2))
    large = F.array(pair(0, wide.bitwiseAND(127) * 2 + 1), pair(1, shr(wide, 7).bitwiseAND(127)))
    return F.when(v.between(-32, 31), small).otherwise(large)


def run_symbols(value: ColumnLike, zeros: ColumnLike) -> Column:
    """An event's context/byte pairs: the level, then (context 2) the zeros behind it.

    The last byte of the level carries bit 7 when zeros follow.
    """
    symbols, zeros = value_symbols(value), col(zeros)
    last = F.size(symbols) - 1
    flagged = F.transform(
        symbols,
        lambda s, i: F.struct(s["ctx"].alias("ctx"), (s["byte"] + F.when((i == last) & (zeros > 0), 128).otherwise(0)).cast("bigint").alias("byte")),
    )
    tail = F.transform(seven_bit_groups(zeros), lambda b: F.struct(F.lit(2).cast("bigint").alias("ctx"), b.cast("bigint").alias("byte")))
    return F.when(zeros > 0, F.concat(flagged, tail)).otherwise(flagged)


def size_symbols(size: ColumnLike, signed: bool) -> Column:
    """A chunk size (or signed difference) as context/byte pairs of 7 or 14 bits."""
    v = col(size)
    pair = lambda ctx, b: F.struct(F.lit(ctx).cast("bigint").alias("ctx"), b.cast("bigint").alias("byte"))
    fits = v.between(-64, 63) if signed else v < 128
    high = shr(v, 7).bitwiseAND(127) + (F.when(v < 0, 128).otherwise(0) if signed else F.lit(0))
    return F.when(fits, F.array(pair(0, v.bitwiseAND(127) * 2))).otherwise(F.array(pair(0, v.bitwiseAND(127) * 2 + 1), pair(1, high)))


def block_header(kind: ColumnLike, size: ColumnLike) -> Column:
    """Header byte of a process block: three bits of size (7: size follows), five of kind."""
    return F.least(F.when(col(size) <= 5, col(size)).otherwise(7), F.lit(7)) * 32 + col(kind).bitwiseAND(31)
