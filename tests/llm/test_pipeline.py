"""The pipeline against its stages taken apart on the smallest table."""

from collections import Counter

import corpus_pipeline
from latticework.llm import bpe_tree, chosen_path, cube_mix, eod_scan, lang_crf, pii_crf, quality_cnn, scaled_sketch, substring_dedup
from latticework.session import table


def test_stages_take_effect(spark, data_dir):
    docs = table(spark, data_dir, "documents")
    columns = docs.columns
    net = quality_cnn.learn(docs, table(spark, data_dir, "labels"))
    texts = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in quality_cnn.score_quality(docs, net).where("predicted = 1").collect()}
    after = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, after, data_dir).cache()
        assert after.columns == columns, name
        if name == "quality":
            assert {r.doc_id for r in after.collect()} == good
        if name == "near_dedup":
            kept = {r.doc_id for r in after.collect()}
            assert kept == {r.doc_id for r in chosen_path.near_duplicates(docs.where(docs.doc_id.isin(sorted(good)))).where("kept").collect()}
        if name == "personal_data":
            masked = {r.doc_id: r.text for r in after.collect()}
            assert set(masked) == kept and all(not pii_crf.base_spans(t) for t in masked.values())
            assert any(masked[i] != texts[i].text for i in masked)
        if name == "mixing":
            want = {r.doc_id: r.copies for r in cube_mix.mix_sources(docs.where(docs.doc_id.isin(sorted(kept))).drop("text").join(spark.createDataFrame(list(masked.items()), "doc_id long, text string"), "doc_id")).collect()}
            assert Counter(r.doc_id for r in after.collect()) == Counter({i: n for i, n in want.items() if n})
    encoder = bpe_tree.PairTreeBPE(bpe_tree.vocabulary())
    sizes = {i: len(encoder.encode([t])[0][0]) // 4 for i, t in masked.items()}
    rows = corpus_pipeline.run(spark, data_dir).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((i, sizes[i]) for i, n in want.items() for _ in range(n))


ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "plain words here", "en", "s", 16), (3, "plain words here", "en", "s", 16), (None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5), (3, "another text under the same id", "fr", None, 3), (2**63 - 1, "far id", "de", "t", 6), (-(2**63), "far id too", "de", "t", 10), (7, "w" * 1_000_000, "en", "s", 9), (8, "1" * 100_000 + " and " + "a@" * 2000, "en", "t", 1)]
CLASH = "row kept_id taken_id copy row_ _salt _part rep component score size taken copies first seed cut held_out lead".split()


def odd_docs(spark):
    """Null, repeated and far ids, texts under one id, long words, and columns named like internal ones."""
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH)
    return spark.createDataFrame([(*r, *[k] * len(CLASH)) for k, r in enumerate(ODD)], names).repartition(3)


def test_odd_rows_pass(spark, data_dir):
    docs = odd_docs(spark)
    after = corpus_pipeline.near_dedup(spark, docs, data_dir).cache()
    assert after.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in after.collect()) == Counter({(r[0], r[1]): 1 for r in ODD})
    masked = corpus_pipeline.personal_data(spark, docs, data_dir)
    assert Counter(r.doc_id for r in masked.collect()) == Counter(r[0] for r in ODD)
    want = Counter()
    for r in cube_mix.mix_sources(docs).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    mixed = corpus_pipeline.mixing(spark, docs, data_dir)
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixed.collect()) == Counter({k: n for k, n in want.items() if n})
    good = corpus_pipeline.quality(spark, docs, data_dir)
    assert good.columns == docs.columns and good.count() <= len(ODD)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data_dir)
    docs.collect()


def test_repeated_ids_are_mixed_row_by_row(spark, data_dir):
    rows = [(1, f"text {'w ' * (k % 7 + 1)}", "en", "s", 0) for k in range(40)] + [(None, "null id text", "en", "t", 0)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mixing(spark, docs, data_dir).collect()
    sizes = Counter()
    for r in cube_mix.mix_sources(docs).collect():
        sizes[r.source] += r.taken
    got = Counter()
    for r in out:
        got[r.source] += len(r.text.split())
    assert got == sizes and got["s"] > 0 and got["t"] > 0
    most = Counter((r[0], r[1], r[3]) for r in rows)
    assert all(n <= 2 * most[k] for k, n in Counter((r.doc_id, r.text, r.source) for r in out).items())


def test_odd_rows_through_all_operators(spark, data_dir):
    docs = odd_docs(spark)
    labels = table(spark, data_dir, "labels")
    n = len(ODD)
    assert pii_crf.find_personal_data(docs).count() == n
    assert quality_cnn.score_quality(docs, quality_cnn.learn(docs, labels)).count() == n
    assert eod_scan.document_tokens(docs).count() == n
    assert lang_crf.predict_languages(docs, lang_crf.learn(docs)).count() == n
    assert cube_mix.mix_sources(docs).count() == n
    assert substring_dedup.drop_repeats(docs).count() == n
    assert len(scaled_sketch.fingerprints(docs).collect()) == n
    assert bpe_tree.encode_documents(docs).count() == n
    assert chosen_path.near_duplicates(docs).count() == n


def test_empty_table(spark, data_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data_dir)
    assert docs.count() == 0
