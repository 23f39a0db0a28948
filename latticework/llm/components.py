"""Connected components by repeated contraction, without leaving the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import pin

#: So many links are joined by one task (a quarter of a megabyte); more are contracted first.
FEW = 1 << 14


def join_all(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of links (a, b) and the smallest end that each reaches."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ends))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return ends, ends[label]
        label = new


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    ends, roots = join_all(rows.column("a").to_numpy(), rows.column("b").to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(ends), pa.array(roots)], names=["component", "p"])


def components(links: DataFrame) -> DataFrame:
    """(v, component) for each end of ``links`` (a, b longs): the smallest v reachable.

    Each round hooks every vertex to its smallest neighbour (a partial
    aggregate, so a hub costs one row a map task), shortens the chains by
    pointer jumping and contracts the links.  A star ends in one round, a chain
    in a number of rounds that grows with the logarithm of its length.  Once at
    most ``FEW`` links are left, one task joins them.
    """
    edges = pin(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().select("v", F.col("v").alias("component"))
    while left := edges.count():
        if left <= FEW:
            parent = pin(edges.coalesce(1).mapInArrow(_joined, "component long, p long"))
            return pin(labels.join(parent, "component", "left").select("v", F.coalesce("p", "component").alias("component")))
        both = edges.select(F.col("b").alias("v"), F.col("a").alias("p")).union(edges.select("a", F.least("a", "b")))
        parent = pin(both.groupBy("v").agg(F.min("p").alias("p")))
        for _ in range(2):
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
        parent = pin(parent)
        labels = pin(
            labels.join(parent.select(F.col("v").alias("component"), "p"), "component", "left").select("v", F.coalesce("p", "component").alias("component"))
        )
        to = lambda c: parent.select(F.col("v").alias(c), F.col("p").alias(f"{c}2"))
        moved = edges.join(to("a"), "a", "left").join(to("b"), "b", "left")
        moved = moved.select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b")).where("a <> b")
        edges = pin(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels
