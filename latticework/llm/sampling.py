"""Bounded samples of labelled rows for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(modulus: int) -> Column:
    """The fold of a document: crc32 of its doc_id as text."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def per_class(rows: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label) of about ``most`` rows of each class, the same on every run.

    Rows are thinned by a hash against the counts of their class, so nothing is
    sorted and no class gathers in one task; a class may exceed ``most`` by the
    spread of that draw (a few per cent).
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("class_rows"))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_003)) / 1_000_003.0
    return rows.join(counts, label).where(drawn < most / F.col("class_rows")).select("doc_id", label)
