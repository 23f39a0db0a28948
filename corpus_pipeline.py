"""A training-data pipeline over ``documents``: quality, near-duplicates, personal data, mixing, tokens.

Each stage takes all rows that the one before kept, with the columns of
``documents``; the last gives token digests.  Stages know rows by their place in
their input, never by doc_id, so rows with a null or repeated doc_id are rows
like any other and extra columns may have any names.  Nulls, empty texts and
repeated rows follow the operators' docstrings: a null text is scored,
deduplicated (it links with nothing), mixed with size 0 and encoded as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import bpe_tree, chosen_path, cube_mix, pii_crf, quality_cnn
from latticework.llm.lineage import numbered, pin, small_batches, stable, unused
from latticework.session import share_code

#: Most row numbers that are broadcast (16 MB); more are joined by a shuffle.
FEW = 1 << 21


def _prepare(spark: SparkSession) -> None:
    share_code(spark)
    small_batches(spark)


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    _prepare(spark)
    return quality_cnn.keep_good(docs, quality_cnn.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of smallest doc_id (null last), of each group of near-duplicates; every row without shingles."""
    _prepare(spark)
    docs = stable(docs)
    rows, key = numbered(docs)
    kept = pin(chosen_path.near_duplicates(docs, extra=("row", "first")).where("first").select(F.col("row").alias(key)))
    kept = F.broadcast(kept) if kept.count() <= FEW else kept  # so whole texts need not move
    return rows.join(kept, key, "left_semi").select(_columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data masked."""
    _prepare(spark)
    return pii_crf.mask_personal_data(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    _prepare(spark)
    docs = stable(docs)
    rows, key = numbered(docs)
    copy = unused(rows, "copy")
    taken = cube_mix.mix_sources(docs, extra=("row",)).where("copies > 0").select(F.col("row").alias(key), F.explode(F.sequence(F.lit(1), "copies")).alias(copy))
    return rows.join(taken, key).select(_columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of each row."""
    _prepare(spark)
    return bpe_tree.encode_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("tokens", tokens)]
ORACLE_SQL = None  # a learned classifier, a seeded draw and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = pin(docs)
    return docs
