"""Run-length events of ordered sequences, as gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coefficient_runs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, event, value, zero_run): each nonzero value with the zeros behind it.

    Zeros before the first nonzero value are one event of value 0 that counts
    all but one of them; a sequence of zeros only is that event alone.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.select(*keys, order, F.col(value).cast("bigint").alias("v"), F.sum((F.col(value) != 0).cast("bigint")).over(upto).alias("event"))
    return marked.groupBy(*keys, "event").agg(F.sum("v").alias("value"), (F.count("*") - 1).alias("zero_run"))


def expand_runs(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position, value) of the nonzero values: places by a running sum, zeros never made."""
    before = Window.partitionBy(*keys).orderBy("event").rowsBetween(Window.unboundedPreceding, -1)
    placed = events.select(*keys, "value", F.coalesce(F.sum(F.col("zero_run") + 1).over(before), F.lit(0)).alias("position"))
    return placed.where("value <> 0")


def signal_runs(rows: DataFrame, keys: list[str], order: str, signal: str) -> DataFrame:
    """(keys, run, signal, count): stretches of equal signals."""
    w = Window.partitionBy(*keys).orderBy(order)
    turned = rows.select(*keys, order, signal, F.coalesce((F.col(signal) != F.lag(signal).over(w)).cast("bigint"), F.lit(0)).alias("turn"))
    marked = turned.select(*keys, signal, F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    return marked.groupBy(*keys, "run", signal).agg(F.count("*").alias("count"))


def differences(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds ``delta``: the value less the one before, the first less 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("delta", F.col(value) - F.lag(value, 1, 0).over(w))
