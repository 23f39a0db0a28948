"""Embedding near-duplicates: spherical k-means cells, blocked cosine products.

Vectors are compared only within a label (and a length: vectors of two lengths
have no cosine).  Equal vectors are one class, with a count.  Spherical k-means
assigns the classes of a group to cells: about sqrt(n) / 2 of them, up to
``MOST_CELLS``.  Its centres are fitted on the driver on a bounded sample
(``PER_CELL`` vectors a cell, ``SAMPLE_BYTES`` in all, of the ``MOST_GROUPS`` largest
groups with more than ``BLOCK`` vectors; any other group is one cell, which
changes the work and not the result).  A vector also visits every other cell it
could have a partner in: if x lies in the cell of c and y in that of d, then y
is within |x - y| of the plane between c and d, and cosine >= t means
|x - y| <= sqrt(2 - 2t).  So all links are found, whatever the cells.

A cell compares its own vectors with its own and its visitors in blocks of at
most ``BLOCK`` by ``BLOCK``, each a task row of its own, so a crowded cell is
spread.  A block returns counts and, for each vector, one link to a root of what
it joined in the block: as many rows as vectors, not pairs.

Defined cases: a vector that is null, zero, or with null or non-finite
components links with nothing, as does one without label; equal vectors link
with each other; every row is a vector of its own, also where rows repeat a
vec_id; a row with null vec_id links like any other but gives no component its
name (a component of such rows only has a null component_id, and null kept);
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .lineage import dealt, fetch, pin, with_totals

PER_CELL = 16
SAMPLE_BYTES = 1 << 25
MOST_GROUPS = 1024
ROUNDS = 6
MOST_CELLS = 4096
BLOCK = 1024


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Unit centres of at most k cells of the unit rows ``x``."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        cell = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        norm = np.sqrt((sums * sums).sum(1))
        centres = np.where(norm[:, None] > 1e-9, sums / np.where(norm > 1e-9, norm, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def visits(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Own cell of each row, and which other cells it has to visit."""
    near = x @ centres.T
    own = near.argmax(1)
    gap = near[np.arange(len(x)), own][:, None] - near
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))[own]
    other = gap <= apart * np.sqrt(2 - 2 * threshold) + 1e-9
    other[np.arange(len(x)), own] = False
    return own, other


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _join_roots(linked: np.ndarray, ids: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches inside the block."""
    everyone, at = np.unique(np.concatenate([ids, others]), return_inverse=True)
    row, col = at[: len(ids)], at[len(ids) :]
    label = np.arange(len(everyone))
    i, j = np.nonzero(linked)
    a, b = row[i], col[j]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return everyone[label]
        label = new


def _centres(reps: DataFrame) -> dict[int, np.ndarray]:
    """Unit centres of the cells of each crowded group, from a bounded sample on the driver."""
    sized = reps.groupBy("group").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).where(F.col("n") > BLOCK)
    crowded = {r.group: (r.n, r.width) for r in sized.orderBy(F.desc("n"), "group").limit(MOST_GROUPS).collect()}
    cells = {g: int(min(MOST_CELLS, max(1, np.sqrt(n) / 2))) for g, (n, _) in crowded.items()}
    wanted = sum(8 * width * PER_CELL * cells[g] for g, (_, width) in crowded.items())
    less = min(1.0, SAMPLE_BYTES / max(1, wanted))
    share = reps.sparkSession.createDataFrame([(g, min(1.0, less * PER_CELL * cells[g] / n)) for g, (n, _) in crowded.items()], "group long, share double")
    drawn = F.pmod(F.xxhash64("rep"), F.lit(1_000_003)) / 1_000_003.0
    sample: dict[int, list] = {}
    for r in reps.join(F.broadcast(share), "group").where(drawn < F.col("share")).select("group", "rep", "embedding").collect():
        sample.setdefault(r.group, []).append((r.rep, r.embedding))
    return {g: spherical_kmeans(unit(np.array([e for _, e in sorted(got)])), cells[g]) for g, got in sample.items()}


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    plain = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0)
    rows = pin(given.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.xxhash64("label", F.size("embedding")).alias("group"), "label", "embedding", F.coalesce(plain, F.lit(False)).alias("plain")))
    # Equal vectors of a label are one class, known by the number of its first row.
    same = ["label", "embedding"]
    reps = pin(rows.where("plain").groupBy(*same).agg(F.min("row").alias("rep"), F.count("*").alias("m"), F.min("vec_id").alias("name"), F.first("group").alias("group")))
    member = rows.where("plain").select("row", "vec_id", F.xxhash64(*same).alias("key"), *same)
    member = with_totals(member, ["key", *same], "row", [F.min("row").alias("rep"), F.count("*").alias("m")]).select("row", "vec_id", "rep", "m")
    shared = reps.sparkSession.sparkContext.broadcast(_centres(reps))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("group").to_numpy()
            for g in np.unique(groups).tolist():
                at = np.flatnonzero(groups == g)
                part = batch.take(pa.array(at))
                x = unit(_matrix(part.column("embedding")))
                if g in shared.value:
                    own, other = visits(x, shared.value[g], threshold)
                else:  # few vectors, or none was drawn: one cell
                    own, other = np.zeros(len(x), np.int64), np.zeros((len(x), 1), bool)
                r, c = np.nonzero(other)
                take = np.concatenate([np.arange(len(x)), r])
                flat = pa.array(x[take].ravel())
                units = pa.ListArray.from_arrays(pa.array(np.arange(len(take) + 1, dtype=np.int32) * x.shape[1]), flat)
                label = part.column("label").take(pa.array(take))
                home = np.concatenate([np.ones(len(x), bool), np.zeros(len(r), bool)])
                cell = pa.array(np.concatenate([own, c]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [label, pa.array(np.full(len(take), g)), cell, pa.array(home), part.column("rep").take(pa.array(take)), part.column("m").take(pa.array(take)), units],
                    names=["label", "group", "cell", "home", "rep", "m", "unit"],
                )

    by = ["label", "group", "cell"]
    placed = pin(reps.mapInArrow(place, "label string, group long, cell int, home boolean, rep long, m long, unit array<double>"))
    # Blocks of a cell: own vectors by side a, all of the cell by side b.
    slim = placed.select(*by, "home", "rep")
    size = [F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).cast("int").alias("na"), F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")]
    size = slim.groupBy(*by).agg(*size)
    salted = placed.join(size, by)
    salt = lambda n: F.pmod(F.xxhash64("rep", F.lit(5)), F.greatest(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = salted.where("home").select(*by, salt(F.col("na")).alias("i"), every("nb").alias("j"), F.lit(True).alias("own"), "rep", "m", "unit")
    b = salted.where("na > 0").select(*by, every("na").alias("i"), salt(F.col("nb")).alias("j"), F.lit(False).alias("own"), "rep", "m", "unit")

    def compare(block):
        own = block["own"].to_numpy()
        ids, m = block["rep"].to_numpy(), block["m"].to_numpy()
        left, right = np.flatnonzero(own), np.flatnonzero(~own)
        if not len(left) or not len(right):
            return block.iloc[:0][["rep"]].assign(n_links=0, root=0)
        x = np.stack(block["unit"].tolist())
        linked = x[left] @ x[right].T >= threshold
        linked &= ids[left][:, None] != ids[right]
        n = linked @ m[right]
        hit = np.flatnonzero(n)
        roots = _join_roots(linked, ids[left], ids[right])
        ends = np.unique(np.concatenate([ids[left], ids[right]]))
        root = lambda k: roots[np.searchsorted(ends, k)]
        first = ids[left][hit]
        touched = np.setdiff1d(ids[right][linked.any(0)], first)
        return type(block)({"rep": np.concatenate([first, touched]), "n_links": np.concatenate([n[hit], np.zeros(len(touched), np.int64)]), "root": np.concatenate([root(first), root(touched)])})

    found = pin(a.union(b).groupBy(*by, "i", "j").applyInPandas(compare, "rep long, n_links long, root long"))
    links = found.groupBy("rep").agg(F.sum("n_links").alias("more"))
    linked = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).join(reps.select(F.col("rep").alias("v"), "name"), "v")
    linked = with_totals(linked, ["component"], "v", [F.min("name").alias("first")]).select(F.col("v").alias("rep"), "first")
    known = reps.select("rep", "name").join(links, "rep", "left").join(linked, "rep", "left").select("rep", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("first", "name").alias("component_id"))
    member = dealt(member, "rep", "row")
    known = fetch(member, member, "rep", known)
    known = known.select("vec_id", (F.col("m") - 1 + F.col("more")).alias("n_links"), "component_id")
    left_out = rows.where("not plain").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(left_out).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
