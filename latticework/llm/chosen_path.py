"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its five-word shingles; documents with equal sets are
one class.  Each set has ``T`` minwise tokens.  A tree branches the classes by
its own minwise tokens: at depth two a node holds those that agree on two of
them.  Every node first links its members to one of them; nodes that after that
still hold several components are compared exhaustively, pair by pair when small
and in blocks when large.  With 20 independent trees of depth two, a pair at
similarity 0.75 misses all nodes with probability (1 - 0.75**2)**20 < 7e-8.

Crowded nodes draw ``PIVOTS`` of their members and compare these with all members
of other components, which joins most of a crowd of near copies in a few rows a
member.  What is left is compared whole, in blocks: each member outside the
node's largest component with all members.  No
node branches on, so a crowd loses no more pairs than any other node.  A set
with too many tokens that no other member of a crowd has cannot be linked and
leaves out.  Blocks give only the links that join components, never pairs.

All links are confirmed on full sets, so none is false.  Members of one
component need no further links among each other, which keeps a group of
thousands of copies linear in its size without dropping any of its links
between components.  Classes are known by the number of a row of theirs, never
by doc_id.

Defined cases: null or blank text has no shingles and links with nothing; a text
of one to four words is one shingle; rows that repeat a doc_id, with the same or
another text, are documents of their own with that id; a row with null doc_id
links like any other but gives no component its name: a component of such rows
only has a null component_id (and null kept); extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .lineage import dealt, fetch, pin, spread, stable, with_totals
from .textscan import Words, mix, run_hash, run_sums, slices, windows

SHINGLE = 5
TREES = 20
T = 2 * TREES
SMALL = 48
BLOCK = 512
PIVOTS = 2
#: Fewest equal minwise tokens of T for an exact comparison; a pair at 0.75 has fewer with probability below 1e-7.
LEAST_EQUAL = 14
SLOT_BITS = 24
_KEYS = np.random.default_rng(77).integers(1, 2**63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted, end to end, and how many each text has."""
    words = Words(batch.column("text"))
    codes = words.hashes(folded=True)
    sums = run_sums(codes)
    start, count = windows(words.first, SHINGLE)
    stop = start + SHINGLE
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    doc = np.concatenate([np.repeat(np.arange(len(count)), count), short])
    value = run_hash(sums, np.concatenate([start, words.first[short]]), np.concatenate([stop, words.first[short + 1]]))
    order = np.lexsort((value, doc)) if len(short) else _sort_within(value, count)
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[fresh], np.bincount(doc[fresh], minlength=len(count))


def _sort_within(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    out, at = np.empty(len(value), np.int64), 0
    for n in count.tolist():
        if n:
            out[at : at + n] = np.argsort(value[at : at + n]) + at
            at += n
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            value, count = shingle_sets(part)
            n, has = len(count), np.flatnonzero(count)
            begin = (np.cumsum(count) - count)[has]
            one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            sig = np.zeros((n, T), np.uint32)
            if len(has):
                one[has] = np.add.reduceat(mix(value.copy()), begin)
                two[has] = np.add.reduceat(mix(value ^ np.uint64(0xA5A5A5A55A5A5A5A)), begin)
                for k in range(T):
                    sig[has, k] = np.minimum.reduceat(((value ^ (value >> np.uint64(29))) * _KEYS[k]) >> np.uint64(16), begin).astype(np.uint32)
            tokens = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * T), pa.array(sig.view(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(_signed(one)), pa.array(_signed(two)), tokens],
                names=["row", "doc_id", "n_shingles", "s1", "s2", "tokens"],
            )


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def sketches(docs: DataFrame) -> DataFrame:
    """Row number, set size, 128-bit set hash and minwise tokens of each document."""
    return _rows(docs).mapInArrow(_sketch, "row long, doc_id long, n_shingles long, s1 long, s2 long, tokens array<int>")


def _slot(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << SLOT_BITS - 6, np.uint64)
    for batch in batches:
        s = _slot(batch.column("id").to_numpy(zero_copy_only=False))
        np.bitwise_or.at(seen, s >> 6, np.uint64(1) << (s & 63).astype(np.uint64))
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(_signed(seen[at]))], names=["w", "bits"])


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, items) for the given row numbers, in one more reading of the texts.

    A bitmap of fixed size (2 MB, whatever the input) spares most other texts
    the work; it only lets through too many, and the join is exact.
    """
    sc = docs.sparkSession.sparkContext
    words = ids.mapInArrow(_mark, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toPandas()
    bitmap = np.zeros(1 << SLOT_BITS - 6, np.int64)
    bitmap[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = sc.broadcast(bitmap)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            s = _slot(batch.column("id").to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0, np.int64)
            hit = (marks[s >> 6] >> (s & 63)) & 1 == 1
            for part in slices(batch.filter(pa.array(hit))):
                value, count = shingle_sets(part)
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(value)))], names=["id", "items"])

    found = _rows(docs).select(F.col("row").alias("id"), "text").mapInArrow(sets, "id long, items array<long>")
    return found.join(ids, "id")


def _own_tokens(sets: DataFrame) -> DataFrame:
    """(rep, own): how many tokens of each set of the crowd no other set of it has."""
    single = sets.select("id", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    own = single.groupBy("id").agg(F.count("*").alias("own"))
    return sets.select("id").join(own, "id", "left").select(F.col("id").alias("rep"), F.coalesce("own", F.lit(0)).alias("own"))


def common_tokens(left: list[np.ndarray], right: list[np.ndarray], width: int = 1 << 13) -> np.ndarray:
    """How many tokens each set of ``left`` shares with each of ``right``."""
    token, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    mine = row < len(left)
    both = np.flatnonzero((np.bincount(at[mine], minlength=len(token)) > 0) & (np.bincount(at[~mine], minlength=len(token)) > 0))
    place = np.full(len(token), -1)
    place[both] = np.arange(len(both))
    row, col = row[place[at] >= 0], place[at][place[at] >= 0]
    out = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, len(both), width):
        cut = (col >= k) & (col < k + width)
        have = np.zeros((len(left) + len(right), min(width, len(both) - k)), np.float32)
        have[row[cut], col[cut] - k] = 1
        out += have[: len(left)] @ have[len(left) :].T
    return out.astype(np.int64)


def _linking(threshold: int):
    def compare(members):
        """Links of the odd members of a block that join different components; as few as join them all."""
        odd = members[members["odd"]].sort_values("rep", ignore_index=True)
        rest = members[~members["odd"] & ~members["rep"].isin(odd["rep"])].sort_values("rep", ignore_index=True)
        every = pd.concat([odd, rest], ignore_index=True)
        if not len(odd) or len(every) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets = [np.asarray(x, np.int64) for x in every["items"]]
        size, rep = every["size"].to_numpy(), every["rep"].to_numpy()
        common = common_tokens(sets[: len(odd)], sets)
        linked = 100 * common >= threshold * (size[: len(odd), None] + size[None, :] - common)
        linked &= np.arange(len(odd))[:, None] < np.arange(len(every))
        i, j = np.nonzero(linked)
        part, out, up = every["component"].to_numpy(), [], {}

        def find(x):
            while (y := up.get(x, x)) != x:
                x = y
            return x

        for a, b in zip(i.tolist(), j.tolist()):
            x, y = find(part[a]), find(part[b])
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((rep[a], rep[b]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return compare


def _links_in_crowds(nodes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links between components inside crowded nodes (tree, node, rep, component, size).

    Members outside a node's largest component (side i) meet all members (side
    j) in blocks of at most about ``BLOCK`` by ``BLOCK``, each a group of its own,
    so a node of any size is spread; only links come out.
    """
    by = ["tree", "node"]
    held = nodes.groupBy(*by, "component").agg(F.count("*").alias("c")).groupBy(*by)
    sized = held.agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("most"))
    many = lambda n: F.ceil(n / BLOCK).cast("int")
    sized = sized.select(*by, F.col("most.component").alias("main"), many(F.col("n")).alias("all_parts"), many(F.col("n") - F.col("most.c")).alias("odd_parts"))
    key = F.struct(*by).alias("key")
    salted = spread(nodes.select("*", key), sized.select(key, "main", "all_parts", "odd_parts"), "key", "rep")
    mine = lambda parts: F.pmod(F.xxhash64("rep", F.lit(9)), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    odd = salted.where("component <> main").select(*by, "rep", "component", "size", mine("odd_parts").alias("i"), every("all_parts").alias("j"), F.lit(True).alias("odd"))
    rest = salted.select(*by, "rep", "component", "size", every("odd_parts").alias("i"), mine("all_parts").alias("j"), F.lit(False).alias("odd"))
    blocks = odd.union(rest).join(sets.withColumnRenamed("id", "rep"), "rep")
    return blocks.groupBy(*by, "i", "j").applyInPandas(_linking(threshold), "a long, b long")


def _alike(x: str, y: str) -> Column:
    """Whether enough minwise tokens are equal for an exact comparison."""
    equal = F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, e: s + e)
    return equal >= LEAST_EQUAL


def _confirmed(pairs: DataFrame, tokens: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) that look alike and whose full sets reach ``threshold`` per cent.

    Side a may be one document for very many pairs; b is in few of them.
    """
    side = lambda c, df, *names: df.select(F.col(df.columns[0]).alias(c), *[F.col(n).alias(f"{n}_{c}") for n in names])
    fits = (100 * F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b")) & _alike("tokens_a", "tokens_b")
    pairs = dealt(pairs, "a", "b")
    near = fetch(pairs.join(side("b", tokens, "tokens", "size"), "b"), pairs, "a", side("a", tokens, "tokens", "size")).where(fits)
    near = pin(near.select(*pairs.columns))
    both = fetch(near.join(side("b", sets, "items"), "b"), near, "a", side("a", sets, "items"))
    common = F.size(F.array_intersect("items_a", "items_b"))
    linked = 100 * common >= threshold * (F.size("items_a") + F.size("items_b") - common)
    return pin(both.where(linked).select("a", "b"))


def _named(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (tree, node, rep) with the component that ``links`` give each rep."""
    found = components(links).select(F.col("v").alias("rep"), "component")
    return nodes.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _several(nodes: DataFrame, *totals: Column) -> DataFrame:
    """The rows of nodes that hold more than one component, with ``n`` and ``totals``."""
    have = [F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), *totals]
    return with_totals(nodes, ["tree", "node"], "rep", have, "lo <> hi").drop("lo", "hi")


def near_duplicates(docs: DataFrame, threshold: int = 75, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest linked doc_id), kept.

    Of ``extra``, "row" adds the row's number and "first" whether it stands for
    its component: the row of smallest doc_id (null last) and then row number.
    """
    docs = stable(docs)
    drawn = pin(sketches(docs))
    classes = ["n_shingles", "s1", "s2"]
    slim = drawn.where("n_shingles > 0").select("row", "doc_id", *classes)
    lead = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    member = pin(with_totals(slim, classes, "row", [F.min("row").alias("rep"), F.min(lead).alias("lead")]).drop("s1", "s2"))
    reps = member.where("row = rep").select("rep", "lead")
    tokens = pin(drawn.select(F.col("row").alias("rep"), "tokens", F.col("n_shingles").alias("size")).join(reps, "rep"))

    branch = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.get("tokens", 2 * t), F.get("tokens", 2 * t + 1)))
    placed = tokens.select("rep", F.posexplode(branch).alias("tree", "node"))
    nodes = pin(with_totals(placed, ["tree", "node"], "rep", [F.count("*").alias("n"), F.min("rep").alias("pivot")], "n > 1"))
    sets = pin(_full_sets(docs, nodes.select(F.col("rep").alias("id")).distinct()))
    tokens = tokens.select("rep", "tokens", "size", "lead")
    star = pin(nodes.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
    links = _confirmed(star, tokens, sets, threshold)

    nodes = pin(_several(_named(nodes.where("n > 2").select("tree", "node", "pivot", "rep"), links)))
    # Nodes of a few members: pairs of different components.
    few = nodes.where(F.col("n") <= SMALL)
    right = few.select("tree", "node", F.col("rep").alias("b"), F.col("component").alias("other"))
    left = few.select("tree", "node", "pivot", F.col("rep").alias("a"), "component")
    pairs = left.join(right, ["tree", "node"]).where("a < b and component <> other and a <> pivot").select("a", "b").distinct()
    pairs = pin(pairs)
    links = links.union(_confirmed(pairs, tokens, sets, threshold))

    # Crowded nodes: a few members against all, then what is left in blocks.
    crowds = nodes.where(F.col("n") > SMALL).select("tree", "node", "rep")
    if not crowds.isEmpty():
        drawn_by = [F.min(F.struct(F.xxhash64("rep", F.lit(k)), "rep", "component")).alias(f"p{k}") for k in range(PIVOTS)]
        crowds = pin(_several(_named(crowds, links), *drawn_by))
        chosen = crowds.select("rep", "component", F.explode(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("p")).where("component <> p.component")
        pairs = pin(chosen.select(F.col("p.rep").alias("a"), F.col("rep").alias("b")).distinct())
        links = pin(links.union(_confirmed(pairs, tokens, sets, threshold)))
        crowds = crowds.select("tree", "node", "rep")
        left_over = _several(_named(crowds, links)).drop("n")
        held = pin(left_over.select(F.col("rep").alias("id")).distinct().join(sets, "id"))
        known = tokens.join(_own_tokens(held), "rep").where(100 * (F.col("size") - F.col("own")) >= threshold * F.col("size"))
        left_over = pin(_several(left_over.join(known.select("rep", "size"), "rep")).drop("n"))
        links = links.union(pin(_links_in_crowds(left_over, held, threshold)))

    found = components(links)
    # The smallest doc_id of each component of several classes; any other class is named by its own.
    linked = found.join(tokens.select(F.col("rep").alias("v"), "lead"), "v")
    linked = with_totals(linked, ["component"], "v", [F.min("lead").alias("first")]).select(F.col("v").alias("rep"), "first")
    out = member.join(linked, "rep", "left").select("row", "doc_id", "n_shingles", F.coalesce("first", "lead").alias("lead"))
    alone = drawn.where("n_shingles = 0").select("row", "doc_id", "n_shingles", lead.alias("lead"))
    out = out.union(alone).select("row", "doc_id", "n_shingles", F.col("lead.doc_id").alias("component_id"), (F.col("doc_id") == F.col("lead.doc_id")).alias("kept"), (F.col("row") == F.col("lead.row")).alias("first"))
    return out.select("doc_id", "n_shingles", "component_id", "kept", *extra)
