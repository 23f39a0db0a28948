"""Byte streams of units: splitting into rows, and access units over rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.framing import split_units, unit_type

PICTURES_BELOW = 11


def access_unit_index(keys: list[str], order: str, picture: str) -> Column:
    """Number of a unit's access unit: each picture unit opens one, what precedes the first belongs to it."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.greatest(F.sum(F.col(picture).cast("bigint")).over(upto), F.lit(1).cast("bigint"))


def units(streams: DataFrame, key: str = "stream_id") -> DataFrame:
    """(key, unit_idx, start, length, type, data) of the units in binary ``data`` rows."""
    kind = streams.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(key).to_pylist(), batch.column("data").to_pylist()):
                for i, (s, n) in enumerate(split_units(data or b"")):
                    rows.append((k, i, s, n, unit_type(data[s : s + n]), data[s : s + n]))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [batch.schema.field(key).type, *[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[key, "unit_idx", "start", "length", "type", "data"])

    return streams.select(key, "data").mapInArrow(run, f"{key} {kind}, unit_idx long, start long, length long, type long, data binary")


def access_units(parts: DataFrame, key: str = "stream_id") -> DataFrame:
    """(key, au, start, length) over the rows of ``units``."""
    marked = parts.withColumn("picture", F.col("type") < PICTURES_BELOW).withColumn("au", access_unit_index([key], "unit_idx", "picture"))
    return marked.groupBy(key, "au").agg(F.min("start").alias("start"), F.sum("length").alias("length"))
