"""Cutting lineage in the folder that the whole cluster shares, row numbers, and joins whose keys may be hot."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle as pin

__all__ = ["dealt", "fetch", "numbered", "pin", "small_batches", "spread", "stable", "unused", "with_totals", "written"]

SALTS = 64
#: Rows of one key that a task gets where ``dealt`` cuts it.
PART = 1024


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Send long texts to Python in smaller batches, for executors with little memory beside their heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def written(df: DataFrame) -> DataFrame:
    """As ``pin``, but as a compressed table: for many narrow rows."""
    spark = df.sparkSession
    pin(spark.range(1))  # sees to the folder
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stable(df: DataFrame) -> DataFrame:
    """``df`` if its rows come in the same order whenever it is read (files, kept rows), else a kept copy of it."""
    kind = df._jdf.queryExecution().analyzed().getClass().getSimpleName()
    return df if kind in ("LogicalRelation", "LogicalRDD") else pin(df)


def numbered(df: DataFrame, name: str = "row") -> tuple[DataFrame, str]:
    """``df`` with a column that numbers its rows, and that column's name.

    A row's number comes from its partition and its place there, so the same
    input has the same numbers in every reading, also after an executor is lost.
    """
    name = unused(df, name)
    return stable(df).withColumn(name, F.monotonically_increasing_id()), name


def _salted(rows: DataFrame, salt: str) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))


def _there() -> Column:
    """The shares that a mask of them names, a row each."""
    return F.expr(f"explode(filter(sequence(0, {SALTS - 1}), k -> (shiftright(_mask, k) & 1) = 1))").alias("_salt")


def with_totals(rows: DataFrame, by: list[str], salt: str, totals: list[Column], having: str | None = None) -> DataFrame:
    """Each row of ``rows`` with the aggregates of its group (``by``, not null), without a group in one task.

    Groups are aggregated in parts.  Their result goes only to those of the
    ``SALTS`` shares of its key that have rows (a mask says which), so it is
    never more rows than ``rows``, and a key of any weight is spread.
    """
    salted = _salted(rows, salt)
    found = salted.groupBy(*by).agg(*totals, F.expr("bit_or(shiftleft(1L, _salt))").alias("_mask"))
    if having:
        found = found.where(having)
    return salted.join(found.select("*", _there()).drop("_mask"), [*by, "_salt"]).drop("_salt")


def spread(rows: DataFrame, table: DataFrame, key: str, salt: str = "row") -> DataFrame:
    """``rows`` (read twice) joined with ``table`` (one narrow row a key) on ``key``, in shares of each key as above."""
    salted = _salted(rows, salt)
    found = salted.groupBy(key).agg(F.expr("bit_or(shiftleft(1L, _salt))").alias("_mask")).join(table, key)
    return salted.join(found.select("*", _there()).drop("_mask"), [key, "_salt"]).drop("_salt")


def dealt(rows: DataFrame, key: str, salt: str) -> DataFrame:
    """``rows`` (narrow, kept) with ``_part`` and ``_parts``: the rows of a key in parts of about ``PART``."""
    sized = with_totals(rows, [key], salt, [F.ceil(F.count("*") / PART).cast("int").alias("_parts")])
    return pin(sized.withColumn("_part", F.pmod(F.xxhash64(salt, F.lit(3)), F.col("_parts")).cast("int")))


def fetch(rows: DataFrame, keys: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``rows`` that ``dealt`` gave joined with ``table`` (one wide row a key): a copy of it for each part.

    ``keys`` are the dealt rows again, or any of them with all their keys; so a
    key that has most rows is spread, and a wide row moves once a part.
    """
    parts = keys.select(key, "_parts").distinct()
    wide = parts.join(table, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return rows.join(wide, [key, "_part"])
