"""Mixing sources to target weights by the cube method.

Sources in code point order (null last) weigh 3, 1, 2 and so on in turn and
share 150 % of all words; no source gets more than twice its words, and what it
cannot take is shared out again.  A source's rate is target / size: every
document of it is taken floor(rate) times, and once more with probability
rate - floor(rate).  Those extra takes are drawn by balanced sampling: three
undecided documents at a time move their probabilities along the null space of
(document count, word count), so both totals of the source stay as they were
until at most two documents are undecided.  Buckets of a source move on their
own, largest documents first; what they leave is gathered and moved again, and
the last two are landed on the nearest total.

Any number of sources is fine: they are ranked and shared out as a table.  Words
not yet shared go to the open sources at one rate a weight; each round closes
those that this would overfill, and the driver sees the totals of a round only.
A source's figures reach its documents in shares of its key, so a source of any
size is spread.

Defined cases: null or blank text has size 0; null source is a source of its
own; repeated rows are documents of their own; a source without words has target
0 and its documents are not taken; extra columns are ignored; an empty table
gives an empty result.  Draws depend on doc_id, size and the seed only (rows with
null doc_id: on their place), so reruns agree.
"""

from __future__ import annotations

import bisect
import itertools
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import pin, spread, stable
from .textscan import Words, slices

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BUCKET = 2048
EPS = 1e-9


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            counts = Words(part.column("text")).counts.astype("int64")
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "source")), pa.array(counts)], names=["row", "doc_id", "source", "size"])


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` (source, ..) with ``g``, their place in code point order, null last.

    A distributed sort gives places inside a partition; one number a partition
    shifts them.
    """
    placed = pin(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = dict(zip((p for p, _ in sizes), itertools.accumulate([0, *(n for _, n in sizes)])))
    offset = F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]) if before else F.create_map(F.lit(0), F.lit(0))
    return placed.withColumn("g", (offset[part] + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_at")


def share_out(sources: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (g, size, ..) with ``target``: by weight, none above ``most`` times its size."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("g") % len(weights) + 1).cast("int"))
    sources = pin(sources.withColumn("_weight", weight).withColumn("_full", F.col("size").cast("double") * most))
    rate = 0.0
    while True:  # the rate only grows, so a closed source stays closed
        closed = F.col("_full") < F.col("_weight") * rate
        r = sources.agg(F.sum("size").alias("all"), F.sum(F.when(closed, F.col("_full")).otherwise(0.0)).alias("gone"), F.sum(F.when(closed, 0.0).otherwise(F.col("_weight"))).alias("open")).first()
        now = (share * (r["all"] or 0) - (r["gone"] or 0.0)) / r["open"] if r["open"] else rate
        if now <= rate:
            return sources.withColumn("target", F.least("_full", F.col("_weight") * rate)).drop("_weight", "_full")
        rate = now


def _flight(pi: list[float], size: list[int], rng: random.Random) -> list[int]:
    """Move ``pi`` in place until at most two entries are undecided; returns those."""
    active: list[int] = []
    queue = iter(k for k in range(len(pi)) if EPS < pi[k] < 1 - EPS)
    while True:
        active += itertools.islice(queue, 3 - len(active))
        if len(active) < 2 or len(active) == 2 and size[active[0]] != size[active[1]]:
            return active
        if len(active) == 2:
            u = (1.0, -1.0)
        else:
            a, b, c = (size[k] for k in active)
            u = (float(c - b), float(a - c), float(b - a)) if a != b or b != c else (1.0, -1.0, 0.0)
        up = min((1 - pi[k]) / x if x > 0 else pi[k] / -x for k, x in zip(active, u) if x)
        down = min(pi[k] / x if x > 0 else (1 - pi[k]) / -x for k, x in zip(active, u) if x)
        step = up if rng.random() * (up + down) < down else -down
        for k, x in zip(active, u):
            pi[k] += step * x
            if pi[k] < EPS or pi[k] > 1 - EPS:
                pi[k] = float(round(pi[k]))
        active = [k for k in active if 0 < pi[k] < 1]


def _land(pi: list[float], size: list[int], left: list[int]) -> None:
    """Decide the last undecided entries so that words, then documents, come nearest."""
    words, count = sum(p * s for p, s in zip(pi, size)), sum(pi[k] for k in left)
    fixed = words - sum(pi[k] * size[k] for k in left)
    best = min(
        itertools.product((0, 1), repeat=len(left)),
        key=lambda t: (abs(sum(x * size[k] for x, k in zip(t, left)) + fixed - words), abs(sum(t) - count), t),
    )
    for k, x in zip(left, best):
        pi[k] = float(x)
    for _ in range(4):  # exchange a taken for an untaken document while the word total comes nearer
        rest = words - sum(p * s for p, s in zip(pi, size))
        out = sorted((size[k], k) for k in range(len(pi)) if pi[k] == 0)
        near = []
        for k in (k for k in range(len(pi)) if pi[k] == 1):
            at = bisect.bisect_left(out, (size[k] + rest, -1))
            near += [(abs(rest - (s - size[k])), k, j) for s, j in out[max(0, at - 1) : at + 1]]
        if not near or min(near)[0] >= abs(rest):
            break
        _, k, j = min(near)
        pi[k], pi[j] = 0.0, 1.0


def _mover(seed: int, level: int):
    def move(key, rows):
        rows = rows.sort_values(["size", "doc_id", "pi", "row"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        pi, size = rows["pi"].tolist(), rows["size"].tolist()
        left = _flight(pi, size, random.Random(f"{seed}/{level}/{key[0]}/{key[1]}"))
        if rows["buckets"].iloc[0] == 1:
            _land(pi, size, left)
        pi = [float(round(p)) if p < EPS or p > 1 - EPS else p for p in pi]
        return rows.assign(pi=pi)[["g", "row", "doc_id", "size", "n", "pi"]]

    return move


def balanced(df: DataFrame, seed: int) -> DataFrame:
    """``df`` (g, row, doc_id, size, n, pi; n rows in g) with every pi moved to 0 or 1.

    A bucket has about ``BUCKET`` rows.  It leaves two undecided at most, so the
    next level has so many fewer buckets, down to one a source, which lands.
    """
    done, level = [], 0
    while True:
        buckets = F.col("n").cast("double")
        for k in range(level + 1):
            buckets = F.greatest(F.ceil(buckets * (2 if k else 1) / BUCKET), F.lit(1)).cast("double")
        key = F.xxhash64(F.coalesce("doc_id", "row"), "size", F.lit(seed + level))
        salted = df.withColumn("buckets", buckets.cast("long")).withColumn("bucket", F.pmod(key, F.col("buckets")))
        moved = pin(salted.groupBy("g", "bucket").applyInPandas(_mover(seed, level), "g long, row long, doc_id long, size long, n long, pi double"))
        done.append(moved.where("pi in (0.0, 1.0)"))
        df, level = moved.where("pi not in (0.0, 1.0)"), level + 1
        if df.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def mix_sources(docs: DataFrame, seed: int = 11, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken; of ``extra``, "row" is its number."""
    docs = stable(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    sized = pin(docs.mapInArrow(_sizes, "row long, doc_id long, source string, size long"))
    sources = share_out(ranked(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))))
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    whole = F.least(F.floor(rate + EPS), F.lit(MOST)).cast("int")
    plan = pin(sources.select("source", "g", F.col("size").alias("source_size"), "n", "target", whole.alias("whole"), F.greatest(rate - whole, F.lit(0.0)).alias("pi")))
    rows = spread(sized.select(F.struct("source").alias("key"), "row", "doc_id", "size"), plan.select(F.struct("source").alias("key"), "g", "n", "pi"), "key")
    drawn = balanced(rows.drop("key"), seed).select("g", "row", "doc_id", "size", F.col("pi").alias("more"))
    copies = F.col("whole") + F.col("more").cast("int")
    found = spread(drawn, plan.drop("n", "pi"), "g")
    return found.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *extra)
