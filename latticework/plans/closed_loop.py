"""Coding with feedback from frame to frame, to a stream of units and back.

Step widths follow the size of the frame before, matrices its energy, blocks may
be predicted from the temporal buffer, and a frame that its levels do not
improve is dropped.  All of this runs along one stream: its pictures are sorted
in its task and walked batch by batch, so a stream of any length needs the
memory of a few pictures, and streams are spread over tasks.  Within a picture
all blocks of a plane are worked on at once.  Open-loop coding (``plans.codec``)
has no such order and is the one for many frames of one stream.

A picture is one row: its planes' samples end to end in ``data``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import blockmath as bm
from ..functions import framing
from ..functions.payload import Chunk, Slot, read_plain, write_plain
from ..functions.prefix import nonzero_levels, read_signals, signal_chunk, sparse_chunk
from ..functions.quantizers import DEFAULT_MATRIX, INTER, INTRA, plane_step, table_for
from ..operators.base import BaseCodec, RawBase
from ..operators.control import next_step, rate_factor
from .codec import kernel
from .config import PictureConfig, StreamConfig, read_global, read_picture


@dataclass(frozen=True)
class Control:
    """Options of the feedback loops."""

    target_bytes: int | None = None
    step_low: int = 512
    step_top: int = 256
    adapt: bool = True
    beta: float = 0.3
    refresh_every: int = 30
    drop: bool = True
    lambda_div: int = 16
    limits: tuple[tuple[int, int], tuple[int, int]] = ((16, 16384), (1, 4096))


@dataclass
class State:
    """What a stream carries from one frame to the next; the decoder needs the buffers only."""

    low: int = 0
    top: int = 0
    size: int = 0
    matrices: dict[int, tuple[int, ...]] = field(default_factory=dict)
    buffers: dict[int, np.ndarray] = field(default_factory=dict)


def content_matrix(energy: np.ndarray, default: tuple[int, ...], beta: float) -> tuple[int, ...]:
    """Default matrix rescaled by each layer's energy over the geometric mean; half goes away from zero."""
    e = np.maximum(energy, 1e-9)
    mean = max(1e-9, math.exp(float(np.log(e).mean())))
    return tuple(int(min(255, max(1, math.floor(d * (x / mean) ** beta + 0.5)))) for d, x in zip(default, e))


def pack(levels: np.ndarray, order: np.ndarray | None) -> list[bytes]:
    """A chunk of each layer; empty where all is zero."""
    levels = levels if order is None else levels[order]
    at = [np.flatnonzero(levels[:, k]) for k in range(levels.shape[1])]
    return [sparse_chunk(x, levels[x, k], len(levels)) if len(x) else b"" for k, x in enumerate(at)]


def unpack(chunks: list[bytes], count: int, order: np.ndarray | None) -> np.ndarray:
    out = np.zeros((count, len(chunks)), np.int64)
    for k, data in enumerate(chunks):
        if data:
            at, value = nonzero_levels(data, count)
            out[at if order is None else order[at], k] = value
    return out


def signal_runs(signals: np.ndarray) -> list[tuple[int, int]]:
    turns = np.flatnonzero(np.diff(signals)) + 1
    return [(int(s[0]), len(s)) for s in np.split(signals, turns)]


def choose_temporal(source: np.ndarray, guess: np.ndarray, buffer: np.ndarray, size: int, line: bool, tables: dict[int, list], lambda_div: int = 16) -> tuple[np.ndarray, ...]:
    """Levels, numerators, signals and new buffer of blocks that may build on the buffer.

    A clear winner by raw energy is coded once; close ones both ways, and the
    smaller error wins (inter on equal errors).
    """
    plain, built = bm.clip16(source - guess), bm.clip16(source - guess - buffer)
    e_intra, e_inter = ((source - guess) ** 2).sum(1), ((source - guess - buffer) ** 2).sum(1)
    low, high = np.minimum(e_intra, e_inter), np.maximum(e_intra, e_inter)
    close = (10 * low >= 9 * high) & (low > 0)
    level0, made0, num0 = bm.code(built, size, line, tables[INTER], lambda_div=lambda_div)
    level1, made1, num1 = bm.code(plain, size, line, tables[INTRA], lambda_div=lambda_div)
    error0 = ((source - bm.clip16(guess + buffer) - made0) ** 2).sum(1)
    error1 = ((source - bm.clip16(guess + made1)) ** 2).sum(1)
    inter = np.where(close, error0 <= error1, e_inter < e_intra)[:, None]
    held = bm.clip16(np.where(inter, buffer + made0, made1))
    return np.where(inter, level0, level1), np.where(inter, num0, num1), np.where(inter[:, 0], INTER, INTRA), held


def planes_of(data: np.ndarray, cfg: StreamConfig, level: int = 0) -> list[np.ndarray]:
    """The planes of a picture whose samples stand end to end."""
    out, at = [], 0
    for p in range(cfg.planes):
        w, h = cfg.size(level, p)
        out.append(data[at : at + w * h].reshape(h, w))
        at += w * h
    return out


def _tables(cfg: StreamConfig, steps: tuple[int, int], matrices, plane: int, refresh: bool) -> dict[int, dict]:
    """Step tables of level 1 and 0 of a plane."""
    step = lambda level: plane_step(steps[0 if level else 1], plane, level == 0, cfg.multiplier)
    return {level: table_for(step(level), matrices[level], cfg.temporal, level == 0, refresh, cfg.modifier) for level in (1, 0)}


def _order(cfg: StreamConfig, plane: int) -> np.ndarray | None:
    """Pictures that may build on the buffer have their top blocks in block order."""
    return bm.block_order(*cfg.size(0, plane), cfg.block) if cfg.temporal else None


def code_plane(plane: np.ndarray, base: np.ndarray, number: int, buffer: np.ndarray | None, tables: dict[int, dict], cfg: StreamConfig, lambda_div: int) -> tuple:
    """(levels of both levels, numerators, signals, new buffer, decoded samples, samples from the base alone)."""
    size, k, line = cfg.block, kernel(cfg), cfg.scaling_top == "1d"
    one = bm.downscale(plane, cfg.scaling_top, (1 << cfg.depth) - 1)
    guess = bm.upscale(bm.to_internal(base, cfg.depth), cfg.scaling_low, k, cfg.average)
    low, made, num1 = bm.code(bm.to_blocks(bm.clip16(bm.to_internal(one, cfg.depth) - guess), size), size, cfg.scaling_low == "1d", tables[1][INTER], lambda_div=lambda_div, soft=cfg.filter_levels)
    h, w = plane.shape
    wide = bm.upscale(bm.clip16(guess + bm.to_plane(made, size, one.shape[1], one.shape[0])), cfg.scaling_top, k, cfg.average)
    alone = bm.to_sample(bm.upscale(guess, cfg.scaling_top, k, cfg.average), cfg.depth)
    source, ahead, signals = bm.to_blocks(bm.to_internal(plane, cfg.depth), size), bm.to_blocks(wide, size), np.zeros(0, int)
    if buffer is None:
        top, made, num0 = bm.code(bm.clip16(source - ahead), size, line, tables[0][INTER], lambda_div=lambda_div)
    else:
        top, num0, signals, made = choose_temporal(source, ahead, buffer, size, line, tables[0], lambda_div)
    return low, top, num1, num0, signals, made, bm.to_sample(bm.to_plane(bm.clip16(ahead + made), size, w, h), cfg.depth), alone


def code_picture(data: np.ndarray, number: int, state: State, cfg: StreamConfig, control: Control, base_codec: BaseCodec) -> tuple[dict, bytes, np.ndarray, np.ndarray]:
    """Numbers of one coded picture, its unit, its base samples and its decoded samples; moves ``state`` on."""
    size, layers = cfg.block, cfg.block**2
    refresh = not cfg.temporal or not state.buffers or number % control.refresh_every == 0
    if control.target_bytes:
        f = rate_factor(state.size, control.target_bytes)
        state.low, state.top = (next_step(w, f, *limit) for w, limit in zip((state.low, state.top), control.limits))
    line = cfg.scaling_top == "1d"
    for level in (0, 1):
        state.matrices.setdefault(level, DEFAULT_MATRIX[size, line, level])
    chunks: dict[Slot, list[Chunk]] = {}
    energy, made, bases, sse, alone_sse, inter = {0: 0.0, 1: 0.0}, [], [], 0, 0, 0
    buffers = {}
    for p, plane in enumerate(planes_of(data, cfg)):
        peak = (1 << cfg.depth) - 1
        base = base_codec.plane(bm.downscale(bm.downscale(plane, cfg.scaling_top, peak), cfg.scaling_low, peak), cfg.depth)
        tables = _tables(cfg, (state.low, state.top), state.matrices, p, refresh)
        low, top, num1, num0, signals, buffers[p], out, alone = code_plane(plane, base, number, None if refresh else state.buffers[p], tables, cfg, control.lambda_div)
        order = _order(cfg, p)
        for level, packed in ((1, pack(low, None)), (0, pack(top, order))):
            chunks |= {(p, level, k): [Chunk(c)] for k, c in enumerate(packed)}
        if len(signals):
            chunks[p, None, None] = [Chunk(signal_chunk(signal_runs(signals[order])))]
            inter += int((signals == INTER).sum())
        for level, num in ((0, num0), (1, num1)):
            energy[level] = energy[level] + ((num.astype(np.float64) / layers) ** 2).sum(0)
        sse, alone_sse = sse + int(((plane - out) ** 2).sum()), alone_sse + int(((plane - alone) ** 2).sum())
        made.append((out, alone))
        bases.append(base)
    dropped = not any(c[0].present for c in chunks.values()) or control.drop and sse >= alone_sse
    if dropped:
        chunks, sse = {}, alone_sse
    elif cfg.temporal:
        state.buffers = buffers
    picture = PictureConfig(state.low, state.top, refresh, (state.matrices[0], state.matrices[1]))
    body = write_plain(chunks, cfg.planes, layers, not refresh)
    config, unit = picture.bits(), []
    if number == 0:
        unit += [(framing.SEQUENCE, cfg.sequence_bits()), (framing.GLOBAL, cfg.global_bits())]
    unit += [(framing.PICTURE, config), (framing.DATA, body)]
    state.size = len(config) + len(body)
    row = {"frame_idx": number, "step_low": state.low, "step_top": state.top, "bytes": state.size, "sse": sse, "base_only_sse": alone_sse, "dropped": dropped, "inter_blocks": 0 if dropped else inter, "samples": len(data)}
    if control.adapt:
        for level in (0, 1):
            state.matrices[level] = content_matrix(energy[level], DEFAULT_MATRIX[size, line, level], control.beta)
    flat = lambda planes: np.concatenate([x.ravel() for x in planes])
    return row, framing.unit(number == 0, unit), flat(bases), flat([m[1 if dropped else 0] for m in made])


def read_picture_unit(unit: bytes, base: np.ndarray, state: State, cfg: StreamConfig) -> np.ndarray:
    """Decoded samples of a picture from its unit and base samples; moves ``state`` on.

    A picture without any chunk is the base alone and leaves the buffers as they are.
    """
    blocks = dict(framing.read_unit(unit)[1])
    if framing.GLOBAL in blocks and read_global(blocks[framing.GLOBAL], blocks.get(framing.SEQUENCE)) != cfg:
        raise ValueError("the stream has another configuration")
    size, layers, k = cfg.block, cfg.block**2, kernel(cfg)
    picture = read_picture(blocks[framing.PICTURE], layers)
    chunks = {slot: c[0].data for slot, c in read_plain(blocks[framing.DATA], cfg.planes, layers, not picture.refresh).items()}
    coded, out, buffers = any(chunks.values()), [], {}
    for p, plane in enumerate(planes_of(base, cfg, 2)):
        guess = bm.upscale(bm.to_internal(plane, cfg.depth), cfg.scaling_low, k, cfg.average)
        if not coded:
            out.append(bm.to_sample(bm.upscale(guess, cfg.scaling_top, k, cfg.average), cfg.depth))
            continue
        tables = _tables(cfg, (picture.step_low, picture.step_top), picture.matrices, p, picture.refresh)
        restored = lambda level, order, count, signals=None: _residual(unpack([chunks[p, level, j] for j in range(layers)], count, order), tables[level], cfg, level, signals)  # noqa: E731, B023
        (w1, h1), (w, h) = cfg.size(1, p), cfg.size(0, p)
        low = restored(1, None, w1 * h1 // layers)
        wide = bm.upscale(bm.clip16(guess + bm.to_plane(low, size, w1, h1)), cfg.scaling_top, k, cfg.average)
        count, order = w * h // layers, _order(cfg, p)
        if picture.refresh:
            held = restored(0, order, count)
        else:
            signals = np.empty(count, np.int64)
            runs = read_signals(chunks[p, None, None], count)
            signals[order] = np.repeat([s for s, _ in runs], [n for _, n in runs])
            top = restored(0, order, count, signals)
            held = bm.clip16(np.where((signals == INTER)[:, None], state.buffers[p] + top, top))
        buffers[p] = held
        out.append(bm.to_sample(bm.to_plane(bm.clip16(bm.to_blocks(wide, size) + held), size, w, h), cfg.depth))
    if coded and cfg.temporal:
        state.buffers = buffers
    return np.concatenate([x.ravel() for x in out])


def _residual(levels: np.ndarray, table: dict, cfg: StreamConfig, level: int, signals: np.ndarray | None) -> np.ndarray:
    """Residual blocks that levels stand for."""
    line = (cfg.scaling_low if level else cfg.scaling_top) == "1d"
    back = bm.matrices(cfg.block, line)[1]
    made = np.zeros_like(levels)
    for signal in (INTER, INTRA):
        mine = np.ones(len(levels), bool) if signals is None and signal == INTER else signals == signal if signals is not None else np.zeros(len(levels), bool)
        step, offset, _ = (np.array(c, np.int64) for c in zip(*table[signal]))
        made[mine] = bm.clip16(bm.dequantize(levels[mine], step, offset) @ back.T)
    return bm.softened(made, *cfg.filter_levels) if level and cfg.filter_levels and cfg.block == 4 else made


COLUMNS = "frame_idx long, step_low long, step_top long, bytes long, sse long, base_only_sse long, dropped boolean, inter_blocks long, samples long"
STREAM = "unit binary, base array<int>, output array<int>"


def along_streams(rows: DataFrame, key: str, fresh: Callable[[], State], step: Callable, schema: str) -> DataFrame:
    """Rows that ``step(state, row)`` makes of the pictures of each stream in order, a batch at a time."""
    names = [c.split()[0] for c in schema.split(", ")]
    kind = rows.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), fresh()
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                if (stream := row[key].as_py()) != now:
                    now, state = stream, fresh()
                out.append((stream, *step(state, row)))
            cols = [pa.array(list(c), t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(cols, names=[key, *names])

    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = f"{key} {kind}, {schema}"
    types = [f.type for f in to_arrow_schema(rows.sparkSession.createDataFrame([], out_schema).schema)]
    return rows.repartition(key).sortWithinPartitions(key, "frame_idx").mapInArrow(walk, out_schema)


def _samples(x: pa.Scalar) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False).astype(np.int64)


def code_streams(planes: DataFrame, key: str, cfg: StreamConfig, control: Control | None = None, base_codec: BaseCodec | None = None, stream: bool = False) -> DataFrame:
    """One row a picture of (key, frame_idx, data) rows, coded in order in each stream.

    With ``stream`` also its unit, its base samples and its decoded samples.
    """
    control, base_codec = control or Control(), base_codec or RawBase()
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def step(state: State, row: dict) -> tuple:
        made, unit, base, output = code_picture(_samples(row["data"]), row["frame_idx"].as_py(), state, cfg, control, base_codec)
        return (*(made[n] for n in names), *((unit, base.astype(np.int32), output.astype(np.int32)) if stream else ()))

    return along_streams(planes.select(key, "frame_idx", "data"), key, lambda: State(control.step_low, control.step_top), step, f"{COLUMNS}, {STREAM}" if stream else COLUMNS)


def decode_streams(coded: DataFrame, key: str, cfg: StreamConfig) -> DataFrame:
    """(key, frame_idx, data): decoded samples from (key, frame_idx, unit, base) rows."""

    def step(state: State, row: dict) -> tuple:
        return row["frame_idx"].as_py(), read_picture_unit(row["unit"].as_py(), _samples(row["base"]), state, cfg).astype(np.int32)

    return along_streams(coded.select(key, "frame_idx", "unit", "base"), key, State, step, "frame_idx long, data array<int>")
