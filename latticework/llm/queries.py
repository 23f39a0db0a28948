"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import share_code, table


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii_crf import find_personal_data

    share_code(spark)
    return find_personal_data(table(spark, sf_dir, "documents"))


def op2_embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_cells import near_duplicates

    share_code(spark)
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_cnn import learn, score_quality

    share_code(spark)
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, learn(docs, table(spark, sf_dir, "labels")))


def op4_eod_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .eod_scan import document_tokens

    share_code(spark)
    return document_tokens(table(spark, sf_dir, "documents"))


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_crf import learn, predict_languages

    share_code(spark)
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, learn(docs))


def op6_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cube_mix import mix_sources

    share_code(spark)
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import drop_repeats

    share_code(spark)
    return drop_repeats(table(spark, sf_dir, "documents"), digest=True)


def op8_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scaled_sketch import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_tree import encode_documents

    share_code(spark)
    return encode_documents(table(spark, sf_dir, "documents"))


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chosen_path import near_duplicates
    from .lineage import small_batches

    share_code(spark)
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii_crf, op2_embedding_cells, op3_quality_cnn, op4_eod_scan, op5_language_crf, op6_cube_mix, op7_substring_dedup, op8_scaled_sketch, op9_bpe_tree, op10_chosen_path)
}
_WORDS = r"[^\x20\x09-\x0D]+"
ORACLES: dict[str, str] = {
    "op2_embedding_cells": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op7_substring_dedup": f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
win AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w),
ord AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s:s + 19], ' ') ORDER BY doc_id, s) AS rn FROM win),
cov AS (SELECT DISTINCT doc_id, s + o.i AS i FROM ord, range(20) o(i) WHERE rn > 1),
wd AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT wd.doc_id, count(cov.i) AS n_removed, string_agg(word, ' ' ORDER BY wd.i) FILTER (WHERE cov.i IS NULL) AS t FROM wd LEFT JOIN cov ON cov.doc_id = wd.doc_id AND cov.i = wd.i GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op10_chosen_path": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS s FROM w WHERE len(ws) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS k FROM places),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}
