"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

The sketch of a text keeps every hash of its five-word shingles that is below a
fixed fraction (1 / ``SCALE``) of the range.  Sketches of any texts thus hold
the same sample of shingles: they merge by union, and the share of the smaller
sketch that the other holds estimates containment however unequal the texts.

A fingerprint is the sorted kept hashes in hex.  Likeness is that containment
estimate; if a sketch is empty it is 1 for equal texts and 0 otherwise.

The next document is found without sorting all documents in one task: ids are
cut at quantiles and between these evenly into ranges of about ``RANGE`` rows, a
window inside each range gives all but the last its successor, and the last
takes the first of the next range.  Ids may be spread over all longs in any way:
a few far from all others leave the rest in ranges of at most a quantile.

Defined cases: null text is empty; a text of one to four words is one shingle;
an empty text has an empty fingerprint; the next document goes by doc_id (null
first), then text, so rows that repeat a doc_id follow each other; a table of
one row is its own next; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import pin

SCALE = 4
SHINGLE = 5
RANGE = 1500
#: Bounds what is broadcast (16 MB of ids) and the one small window over ranges; beyond it ranges grow.
MOST_RANGES = 1 << 20
#: Quantiles of doc_id that cut the ranges first.
QUANTILES = 1000
SPACES = "[\\x20\\x09-\\x0D]+"


def _once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, not for each element of a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column) -> Column:
    """Sorted distinct shingle hashes (unsigned 32-bit) below the fixed fraction."""
    codes = F.transform(F.filter(F.split(text, SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))

    def kept(c: Column) -> Column:
        last = F.greatest(F.size(c) - (SHINGLE - 1), F.lit(1))
        each = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(c, i, SHINGLE)).bitwiseAND(F.lit(0xFFFFFFFF)))
        low = F.filter(each, lambda h: h < F.lit((1 << 32) // SCALE))
        return F.when(F.size(c) > 0, F.array_sort(F.array_distinct(low))).otherwise(F.array().cast("array<bigint>"))

    return _once(codes, kept)


def fingerprint(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), ",")


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Share of the smaller sketch that the other holds."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.when(same, 1.0).otherwise(0.0))


def merge(a: Column, b: Column) -> Column:
    """Sketch of two texts together."""
    return F.array_sort(F.array_union(a, b))


def _ranges(docs: DataFrame) -> Column:
    """Number of the range that a doc_id falls in: ascending with the id, -1 for null."""
    n = docs.count()
    many = max(1, min(MOST_RANGES, -(-n // RANGE)))
    cuts = min(QUANTILES, many)
    levels = [k / cuts for k in range(cuts + 1)]
    edges = sorted(set(docs.select(F.percentile_approx("doc_id", levels, 10 * QUANTILES)).first()[0] or [0]))
    inside = -(-many // cuts)
    at = F.lit(edges)
    # The last edge that is not above the id: first among every 32nd edge, then among those behind it.
    coarse = F.size(F.filter(F.lit(edges[32::32]).cast("array<bigint>"), lambda e: e <= F.col("doc_id")))
    fine = F.size(F.filter(F.slice(at, coarse * 32 + 2, 31), lambda e: e <= F.col("doc_id")))
    known = coarse * 32 + fine

    def place(k: Column) -> Column:  # doubles grow with the ids, so their order stays and nothing overflows
        low, high = F.get(at, k).cast("double"), F.coalesce(F.get(at, k + 1), F.get(at, k)).cast("double")
        share = (F.col("doc_id").cast("double") - low) / F.greatest(high - low, F.lit(1.0))
        return k * inside + F.least(F.greatest(F.floor(share * inside), F.lit(0)), F.lit(inside - 1)).cast("int")

    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_once(known, place))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    part = _ranges(docs)
    place = part.alias("part")
    # First row of each range: few rows, a range each.
    heads = docs.groupBy(place).agg(F.min("doc_id").alias("head"))
    over = Window.orderBy("part")
    succ = heads.select("part", F.coalesce(F.lead("head").over(over), F.first("head").over(over)).alias("head"))
    ranges = pin(succ)
    first = docs.join(F.broadcast(ranges.select("head").distinct()), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("head").agg(F.min("text").alias("text"))
    # ... and its text closes the range before: a row that ends the window and is then left out.
    closing = ranges.alias("r").join(first.alias("f"), F.expr("r.head <=> f.head")).select(F.lit(None).cast("long").alias("doc_id"), F.col("f.text").alias("text"), F.col("r.part").alias("part"), F.lit(1).alias("closing"))
    closing = pin(closing)
    shown = docs.select("doc_id", "text", place, F.lit(0).alias("closing")).union(closing).select("*", sketch(F.col("text")).alias("s"))
    inside = Window.partitionBy("part").orderBy("closing", "doc_id", "text")
    both = shown.select("*", F.lead(F.struct("text", "s")).over(inside).alias("n")).where("closing = 0")
    size = F.char_length("text")
    cut = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - cut), F.substring("n.text", F.lit(1), cut))
    made = both.select("doc_id", size.cast("long").alias("n_chars"), "text", "s", "n", edited.alias("edited"))
    made = made.select("*", sketch(F.col("edited")).alias("e"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("s")).alias("fingerprint"),
        fingerprint(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("s"), F.col("n.s"), F.col("text") == F.col("n.text")).alias("near_next"),
    )
