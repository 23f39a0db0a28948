"""Layered coding of frames as DataFrame plans, and the exact inverse.

Open loop: step widths are fixed and frames are independent, so a plan shuffles
only to regroup samples (rows, blocks, layers) and never orders a stream.
Bit-serial work (prefix codes) is one Arrow stage over rows of one chunk each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blockmath as bm
from ..functions.fixedpoint import to_internal, to_sample
from ..functions.prefix import nonzero_levels, sparse_chunk
from ..functions.quantizers import DEFAULT_MATRIX, dequantize, plane_step, table_for
from ..functions.transforms import columns, inverse, names
from ..operators.base import BaseCodec, RawBase
from ..operators import rows as rg
from ..operators.blocks import TU, long_form, soften
from ..operators.stencil import KERNELS, to_rows, to_samples
from .config import StreamConfig

CHUNK = ["frame_idx", "plane", "level", "layer"]


@dataclass
class Coded:
    """What coding a stream gives: base rows, levels of both levels, and the decoder's picture as rows or samples."""

    base: DataFrame
    low: DataFrame
    top: DataFrame
    rows: DataFrame

    @property
    def output(self) -> DataFrame:
        return to_samples(self.rows)


def kernel(cfg: StreamConfig) -> tuple[int, ...]:
    return cfg.taps if cfg.upsampler == "adaptive" else KERNELS[cfg.upsampler]


def pyramid(rows: DataFrame, cfg: StreamConfig) -> tuple[DataFrame, DataFrame]:
    """Level 1 and base of full-size frames, at row grain."""
    one = rg.downscale(rows, cfg.scaling_top, cfg.depth)
    return one, rg.downscale(one, cfg.scaling_low, cfg.depth)


def _internal(rows: DataFrame, depth: int) -> DataFrame:
    return rg.map_rows(rows, lambda v: to_internal(v, depth))


Table = list[tuple[int, int, int]]


def code_blocks(blocks: DataFrame, size: int, line: bool, table: Table | tuple[Table, Table], rdoq: bool = True, improve: bool = True, lambda_div: int = 16, soft: tuple[int, int] | None = None) -> DataFrame:
    """(block, q0.., i0..): levels of blocks with residual r0.. and what they stand for.

    ``table`` may be two, for plane 0 and for the others.  A block whose largest
    residual cannot reach any layer's threshold is zero; with ``improve`` one that
    its levels do not improve is zeroed.  Choosing levels of sixteen layers as
    expressions makes a method that the JVM does not compile, so this one step is
    numpy on Arrow batches; transforms and reconstruction are generated code.
    """
    r, out = names("r", size), [*names("q", size), *names("i", size)]
    by_plane = table if isinstance(table, tuple) else (table, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            residual = np.stack([batch.column(n).to_numpy() for n in r], 1)
            colour = batch.column("plane").to_numpy() > 0
            both = np.zeros((len(out), batch.num_rows), np.int64)
            for side, one in zip((~colour, colour), by_plane):
                if side.any():
                    level, made, _ = bm.code(residual[side], size, line, one, rdoq, improve, lambda_div, soft)
                    both[:, side] = np.concatenate([level, made], 1).T
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in TU), *(pa.array(c) for c in both)], names=[*TU, *out])

    kinds = ", ".join(f"{c} bigint" for c in (*TU, *out))
    return blocks.select(*TU, *[F.col(n).cast("bigint").alias(n) for n in r]).mapInArrow(run, kinds)


def reconstruct(blocks: DataFrame, size: int, line: bool, table: Table | tuple[Table, Table], soft: tuple[int, int] | None = None) -> DataFrame:
    """Adds i0.., the residual that levels q0.. stand for."""
    by_plane = table if isinstance(table, tuple) else (table, table)
    steps = lambda k, j: F.lit(by_plane[0][k][j]) if by_plane[0] == by_plane[1] else F.when(F.col("plane") == 0, by_plane[0][k][j]).otherwise(by_plane[1][k][j])
    values = [dequantize(f"q{k}", steps(k, 0).cast("bigint"), steps(k, 1).cast("bigint")).alias(f"d{k}") for k in range(len(by_plane[0]))]
    plain = blocks.select("*", *values)
    back = [c.alias(n) for c, n in zip(inverse(columns("d", size), size, line), names("i", size))]
    out = plain.select(*[c for c in plain.columns if c[0] != "d"], *back)
    if soft is None or size != 4:
        return out
    return soften(out, *soft, prefix="i", out="f").drop(*names("i", 4)).withColumnsRenamed(dict(zip(names("f", 4), names("i", 4))))


def tables(cfg: StreamConfig, step_low: int, step_top: int) -> dict[int, tuple[Table, Table]]:
    """Step tables of both levels, for plane 0 and for colour planes, for independent frames (matrices go by the top scaling)."""
    line = cfg.scaling_top == "1d"
    steps = {1: step_low, 0: step_top}
    one = lambda level, plane: table_for(plane_step(steps[level], plane, level == 0, cfg.multiplier), DEFAULT_MATRIX[cfg.block, line, level])[0]
    return {level: (one(level, 0), one(level, 1)) for level in (1, 0)}


def _trim(blocks: DataFrame, prefix: str, size: int) -> DataFrame:
    return blocks.select(*TU, *names(prefix, size))


def early_drops(residual_rows: DataFrame, cfg: StreamConfig, step: int, table: Table, rdoq: bool = True, lambda_div: int = 16, stride: int = 8, block_stride: int = 16) -> DataFrame:
    """(frame_idx, dropped): frames whose full coding a sample of plane 0 says is in vain.

    Either more than six tenths of every ``stride``-th sample both ways exceed
    twice the step, or none of every ``block_stride``-th block both ways keeps a
    level.
    """
    luma = residual_rows.where("plane = 0")
    some = luma.where(F.col("y") % stride == 0)
    picked = F.filter("vals", lambda v, i: i % stride == 0)
    counts = some.select("frame_idx", F.size(picked).alias("n"), F.size(F.filter(picked, lambda v: F.abs(v) > 2 * max(step, 1))).alias("over"))
    wide = counts.groupBy("frame_idx").agg((F.sum("over") * 10 > F.sum("n") * 6).alias("coarse"))
    size = cfg.block
    lines = luma.where(F.call_function("div", F.col("y"), F.lit(size)) % block_stride == 0)
    blocks = rg.gather(lines, size).where(F.col("tu_x") % block_stride == 0)
    levels = code_blocks(blocks, size, cfg.scaling_top == "1d", table, rdoq, lambda_div=lambda_div)
    kept = F.greatest(*[F.abs(F.col(n)) for n in names("q", size)]) > 0
    held = levels.groupBy("frame_idx").agg(F.max(kept).alias("kept"))
    return wide.join(held, "frame_idx", "left").select("frame_idx", (F.col("coarse") | ~F.coalesce("kept", F.lit(True))).alias("dropped"))


def encode(frames: DataFrame, cfg: StreamConfig, step_low: int, step_top: int, rdoq: bool = True, base_codec: BaseCodec | None = None, settle: Callable[[DataFrame], DataFrame] = lambda df: df, lambda_div: int = 16, drop_early: bool = False) -> Coded:
    """Base, levels and decoded picture of frames: rows of samples, or rows that are arrays (``vals``).

    Planes of any number and size are coded in one plan, colour planes with their
    own steps.  Samples become rows once; from there on rows, lines of blocks and
    blocks move.  ``settle`` (such as ``session.settle``) keeps what several later
    steps read, so that it is not worked out for each of them.  With
    ``drop_early`` frames that a sample finds not worth coding get no top levels.
    """
    table = tables(cfg, step_low, step_top)
    size, k, soft = cfg.block, kernel(cfg), cfg.filter_levels
    full = frames if "vals" in frames.columns else settle(to_rows(frames))
    one, base = pyramid(full, cfg)
    if base_codec is not None:
        base = to_rows(base_codec.frames(to_samples(base), cfg.depth))
    guess = rg.upscale(_internal(base, cfg.depth), cfg.scaling_low, k, cfg.average)
    low = settle(code_blocks(rg.gather(rg.residual(_internal(one, cfg.depth), guess), size), size, cfg.scaling_low == "1d", table[1], rdoq, lambda_div=lambda_div, soft=soft))
    wide = settle(rg.upscale(rg.add(guess, rg.scatter(low, size, "i")), cfg.scaling_top, k, cfg.average))
    left = rg.residual(_internal(full, cfg.depth), wide)
    if drop_early:
        left = settle(left)
        gone = early_drops(left, cfg, step_top, table[0][0], rdoq, lambda_div).where("dropped").select("frame_idx", "dropped")
        zeros = F.transform("vals", lambda v: F.lit(0).cast("bigint"))
        left = left.join(gone, "frame_idx", "left").select(*rg.ROW, F.when(F.col("dropped"), zeros).otherwise(F.col("vals")).alias("vals"))
    top = settle(code_blocks(rg.gather(left, size), size, cfg.scaling_top == "1d", table[0], rdoq, lambda_div=lambda_div))
    return Coded(base, _trim(low, "q", size), _trim(top, "q", size), _picture(wide, top, cfg))


def _picture(prediction: DataFrame, blocks: DataFrame, cfg: StreamConfig) -> DataFrame:
    out = rg.add(prediction, rg.scatter(blocks, cfg.block, "i"))
    return rg.map_rows(out, lambda v: to_sample(v, cfg.depth))


def _across(cfg: StreamConfig, level: int, total: bool = False) -> Column:
    """Blocks a row of the plane at hand, or in all of it."""
    many = []
    for plane in (0, 1):
        w, h = (n // cfg.block for n in cfg.size(level, plane))
        many.append(w * h if total else w)
    return F.when(F.col("plane") == 0, F.lit(many[0])).otherwise(F.lit(many[1])).cast("bigint")


def chunks(coded: Coded, cfg: StreamConfig) -> DataFrame:
    """(frame_idx, plane, level, layer, total, data): a prefix-coded chunk of each layer that is not all zero.

    Zeros never move: a layer's levels meet with their places, and the runs
    between them are made where the chunk is written.
    """
    parts = []
    for level, blocks in ((1, coded.low), (0, coded.top)):
        rows = long_form(blocks, "q", cfg.block, "q").where("q <> 0").withColumn("level", F.lit(level).cast("bigint"))
        at = F.col("tu_y") * _across(cfg, level) + F.col("tu_x")
        parts.append(rows.select(*CHUNK, _across(cfg, level, total=True).alias("total"), F.struct(at.alias("at"), F.col("q").alias("q")).alias("e")))
    packed = parts[0].union(parts[1]).groupBy(*CHUNK, "total").agg(F.array_sort(F.collect_list("e")).alias("e"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("e")
            at, q = (lists.flatten().field(k).to_numpy() for k in (0, 1))
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            data = [sparse_chunk(at[i:j], q[i:j], n) for i, j, n in zip(ends[:-1], ends[1:], batch.column("total").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*CHUNK, "total")), pa.array(data, pa.binary())], names=[*CHUNK, "total", "data"])

    kinds = ", ".join(f"{c} long" for c in (*CHUNK, "total"))
    return packed.mapInArrow(pack, f"{kinds}, data binary")


def levels_of(stream: DataFrame, cfg: StreamConfig, level: int) -> DataFrame:
    """Blocks of levels q0.. (only blocks with a nonzero one) from chunks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nonzero_levels(d, n) for d, n in zip(batch.column("data").to_pylist(), batch.column("total").to_pylist())]
            row = pa.array(np.repeat(np.arange(len(found)), [len(at) for at, _ in found]))
            both = [pa.array(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in CHUNK), *both], names=[*CHUNK, "position", "value"])

    kinds = ", ".join(f"{c} long" for c in (*CHUNK, "position", "value"))
    found = stream.where(F.col("level") == level).mapInArrow(unpack, kinds)
    across = _across(cfg, level)
    placed = found.select("frame_idx", "plane", F.call_function("div", F.col("position"), across).alias("tu_y"), (F.col("position") % across).alias("tu_x"), "layer", "value")
    cells = [F.coalesce(F.max(F.when(F.col("layer") == k, F.col("value"))), F.lit(0)).alias(n) for k, n in enumerate(names("q", cfg.block))]
    return placed.groupBy(*TU).agg(*cells)


def _dense(levels: DataFrame, rows: DataFrame, cfg: StreamConfig) -> DataFrame:
    """Every block of frames, with zeros where a stream had nothing."""
    held = rg.block_places(rows, cfg.block).join(levels, TU, "left")
    return held.select(*TU, *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names("q", cfg.block)])


def decode(base: DataFrame, stream: DataFrame, cfg: StreamConfig, step_low: int, step_top: int, rows: bool = False) -> DataFrame:
    """Samples of the decoded picture (or its ``rows``) from base rows and chunks."""
    table = tables(cfg, step_low, step_top)
    size, k = cfg.block, kernel(cfg)
    guess = rg.upscale(_internal(base, cfg.depth), cfg.scaling_low, k, cfg.average)
    low = reconstruct(_dense(levels_of(stream, cfg, 1), guess, cfg), size, cfg.scaling_low == "1d", table[1], cfg.filter_levels)
    wide = rg.upscale(rg.add(guess, rg.scatter(low, size, "i")), cfg.scaling_top, k, cfg.average)
    top = reconstruct(_dense(levels_of(stream, cfg, 0), wide, cfg), size, cfg.scaling_top == "1d", table[0])
    out = _picture(wide, top, cfg)
    return out if rows else to_samples(out)
