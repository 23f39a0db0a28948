"""Streams of frames: state from frame to frame, kept in the state store by stream.

Batch recurrences (``operators.control``) fold an ordered array; here frames
come in files or topics and only a few numbers a stream are held.  Frames of a
stream inside one batch are put in order; frames must not come in a later batch
than a frame behind them.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.control import rate_step


def _stateful(stream: DataFrame, key: str, order: str, step, output: str, state: str, zero: tuple) -> DataFrame:
    kind = stream.schema[key].dataType.simpleString()

    def run(keys: tuple[Any, ...], batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else zero
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for row in rows.itertuples(index=False):
            now, made = step(now, row)
            out += [(keys[0], *m) for m in made]
        held.update(now)
        names = [key, *(c.split()[0] for c in output.split(", "))]
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {output}", state, "append", GroupStateTimeout.NoTimeout)


def rate_control(stream: DataFrame, key: str, order: str, complexity: str, target: int, start: tuple[float, float] = (512.0, 256.0)) -> DataFrame:
    """Step widths of each frame from the size of the one before, as ``operators.control.rate_control``."""

    move = rate_step(float(target))

    def step(now, row):
        state, made = move(now, getattr(row, complexity))
        return tuple(map(float, state)), [(int(getattr(row, order)), *map(int, made))]

    return _stateful(stream, key, order, step, f"{order} long, sw1 long, sw2 long, size long", "sw1 double, sw2 double, size double", (*start, 0.0))


def reorder(stream: DataFrame, key: str, decode: str, poc: str, size: str) -> DataFrame:
    """Enhancement units written in decode order: (key, decode, poc, size, written).

    Rows are pictures (``decode`` and ``poc``, ``size`` null) or units (``poc`` and
    ``size``, ``decode`` null), in any order and in any batch.  The state holds
    the units whose picture, and the pictures whose unit, has not come; a picture
    is put out once all before it are.
    """
    kind = stream.schema[key].dataType.simpleString()

    def run(keys: tuple[Any, ...], batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        text, nxt, total = held.get if held.exists else ("[[], []]", 0, 0)
        waiting, units = json.loads(text)
        units = dict(units)
        for rows in batches:
            for d, p, s in zip(rows[decode], rows[poc], rows[size]):
                if pd.isna(s):
                    waiting.append((int(d), int(p)))
                else:
                    units[int(p)] = int(s)
        heapq.heapify(waiting := [tuple(x) for x in waiting])
        out = []
        while waiting and waiting[0][0] == nxt and waiting[0][1] in units:
            d, p = heapq.heappop(waiting)
            total, nxt = total + units[p], nxt + 1
            out.append((keys[0], d, p, units.pop(p), total))
        held.update((json.dumps([waiting, list(units.items())]), nxt, total))
        yield pd.DataFrame(out, columns=[key, decode, poc, size, "written"])

    names = f"{key} {kind}, {decode} long, {poc} long, {size} long, written long"
    return stream.select(key, decode, poc, size).groupBy(key).applyInPandasWithState(run, names, "held string, next long, written long", "append", GroupStateTimeout.NoTimeout)


def temporal_sums(stream: DataFrame, key: str, frame: str, intra: str, value: str) -> DataFrame:
    """A sample's buffer over frames: replaced by intra frames, else added to and clamped to 16 bits."""

    def step(now, row):
        v = int(getattr(row, value))
        held = v if getattr(row, intra) else now[0] + v
        held = max(-32768, min(32767, held))
        return (held,), [(int(getattr(row, frame)), held)]

    return _stateful(stream, key, frame, step, f"{frame} long, buffer long", "buffer long", (0,))


def gop_totals(stream: DataFrame, frame: str, length: int, value: str) -> DataFrame:
    """Tumbling count windows of frames: running totals a group of pictures."""
    return stream.groupBy(F.floor(F.col(frame) / length).cast("bigint").alias("gop")).agg(F.count("*").alias("rows"), F.sum(value).alias("total"))
