"""Token counts of documents in flat token files, by scanning for separators.

A token file is a flat run of little-endian identifiers, each document followed
by an end-of-document identifier, without an index.  It is cut into blocks of
any size.  Each block is searched with vector comparisons and gives the tokens
before its first separator, the gaps between separators, and the tokens after
the last.  A prefix scan over the summaries (one small row a block, without the
gaps) numbers the documents and carries what a block left open into the next,
however many blocks a document spans; the gaps then take their numbers.

Files are read block by block: their list and sizes come from Spark, and a task
seeks to its blocks, so a file may be larger than any task's memory.

Defined cases: an empty document counts 0; what follows the last separator of a
file is a document of its own if it has tokens; blocks hold whole identifiers,
except that a file's last odd bytes are ignored; a null text is an empty document;
repeated rows are documents of their own; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import pin
from .textscan import slices

EOD = 50256
WIDTH = 2
BLOCK = 1 << 19


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_blocks(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Flat token streams of ``docs``, one a task: (file, block, data, ends).

    ``data`` is a block of the stream; ``ends`` lists the doc_ids whose separator
    stands in it, in order: the manifest a counter may join with, not an index
    (it has no positions).
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        eod = np.array([EOD], np.uint16)
        file, number, held, size, ends = None, 0, [], 0, []

        def cut() -> pa.RecordBatch:
            nonlocal number, held, size, ends
            data = np.concatenate(held).astype("<u2").tobytes()
            out = pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([data], pa.binary()), pa.array([ends], pa.list_(pa.int64()))],
                names=["file", "block", "data", "ends"],
            )
            number, held, size, ends = number + 1, [], 0, []
            return out

        for batch in batches:
            for part in slices(batch):
                if file is None:
                    file = part.column("file")[0].as_py()
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(np.array(encode(text) if text else [], np.uint16), eod)
                    while size + len(ids) * WIDTH > block:  # a document runs on into the next block
                        room = (block - size) // WIDTH
                        held.append(ids[:room])
                        ids = ids[room:]
                        yield cut()
                    held.append(ids)
                    size += len(ids) * WIDTH
                    if len(ids):
                        ends.append(doc)
        if held:
            yield cut()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().cast("long").alias("file"))
    return given.mapInArrow(run, "file long, block long, data binary, ends array<long>")


def _open(uri: str):
    """A file system and a path in it for the name that Spark gives a file."""
    from urllib.parse import unquote

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(uri.removeprefix("file:").replace("//", "", 1) if uri.startswith("file://") else uri.removeprefix("file:"))
    return fs.FileSystem.from_uri(uri)


def read_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Blocks (file, block, data) of the flat files under ``path``, each read by seeking; an empty file has none."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    many = F.call_function("div", F.col("length") + (block - 1), F.lit(block))
    places = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("block")).repartition("file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, number in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                system, name = _open(uri)
                with system.open_input_file(name) as f:
                    data = f.read_at(block, number * block)
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([number], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    return places.mapInArrow(run, "file string, block long, data binary")


def _scan(eod: int, width: int, key: str):
    kind = {1: "u1", 2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, head, tail, gaps = [], [], [], []
            for data in batch.column("data"):
                raw = data.as_buffer() if data.is_valid else b""
                ids = np.frombuffer(raw, kind, len(raw) // width)
                at = np.flatnonzero(ids == eod)
                found.append(len(at))
                head.append(int(at[0]) if len(at) else len(ids))
                tail.append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
                gaps.append(np.diff(at) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("block"), pa.array(found, pa.int64()), pa.array(head, pa.int64()), pa.array(tail, pa.int64()), pa.array(gaps, pa.list_(pa.int64()))],
                names=[key, "block", "found", "head", "tail", "gaps"],
            )

    return run


def count_tokens(blocks: DataFrame, eod: int = EOD, width: int = WIDTH) -> DataFrame:
    """(file, ordinal, n_tokens) of each document of each file, from blocks (file, block, data)."""
    kind = blocks.schema["file"].dataType.simpleString().replace("bigint", "long")
    scanned = blocks.select("file", "block", "data").mapInArrow(_scan(eod, width, "file"), f"file {kind}, block long, found long, head long, tail long, gaps array<long>")
    scanned = pin(scanned)
    found = scanned.drop("gaps")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Blocks between two with separators share a stretch; what they and its first block left open carries on.
    placed = found.select("*", F.coalesce(F.sum("found").over(before), F.lit(0)).alias("seen"), F.coalesce(F.sum((F.col("found") > 0).cast("long")).over(before), F.lit(0)).alias("stretch"))
    last = Window.partitionBy("file").orderBy("block")
    inner = placed.select("*", F.lag("tail").over(last).alias("left"), F.lag("found").over(last).alias("before_found"))
    open_ = Window.partitionBy("file", "stretch").orderBy("block")
    inside = F.coalesce(F.sum("tail").over(open_.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The block that opened a stretch (the last one with separators) left its tail.
    opened = F.when(F.col("before_found") > 0, F.col("left")).otherwise(0)
    carried = pin(inner.select("file", "block", "found", "head", "tail", "seen", (inside + F.first(opened).over(open_)).alias("carry")))
    ended = carried.where("found > 0").join(scanned.select("file", "block", "gaps"), ["file", "block"])
    ended = ended.select("file", "seen", F.concat(F.array(F.col("carry") + F.col("head")), F.col("gaps")).alias("counts"))
    docs = ended.select("file", "seen", F.posexplode("counts").alias("k", "n_tokens")).select("file", (F.col("seen") + F.col("k")).alias("ordinal"), "n_tokens")
    # Tokens behind the last separator of a file.
    ends = carried.groupBy("file").agg(F.max(F.struct("block", "found", "seen", "carry", "tail")).alias("z"))
    rest = ends.select("file", (F.col("z.seen") + F.col("z.found")).alias("ordinal"), F.when(F.col("z.found") > 0, F.col("z.tail")).otherwise(F.col("z.carry") + F.col("z.tail")).alias("n_tokens"))
    return docs.union(rest.where("n_tokens > 0"))


def document_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row a document: doc_id, n_tokens, counted in the flat token streams of ``docs``."""
    streams = pin(token_blocks(docs, path))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = streams.select("file", "block", F.size("ends").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seen"))
    listed = streams.select("file", "block", "ends").join(placed, ["file", "block"])
    manifest = listed.select("file", "seen", F.posexplode("ends").alias("k", "doc_id")).select("file", (F.col("seen") + F.col("k")).alias("ordinal"), "doc_id")
    return manifest.join(count_tokens(streams), ["file", "ordinal"]).select("doc_id", "n_tokens")
