"""Joins, dedup and sketches against brute force on small awkward tables."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from latticework.llm import chosen_path, embed_cells, scaled_sketch, substring_dedup, textscan
from latticework.session import share_code

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component long, tokens string"


def odd_texts():
    """Copies, near copies, shared passages, ties, empty, null, blank and very long texts."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = make(120).split(), make(30)
    texts = [None, "", " \t\n", "one", "one", "One two", "a b c d e", "A B c d e", "x " * 60, "x " * 61, make(6000)]
    texts += [" ".join(base)] * 4
    for k in range(70):
        near = list(base)
        for _ in range(k % 12):
            near[rng.randrange(len(near))] = rng.choice(words)
        texts.append(" ".join(near))
    texts += [f"{make(15)} {passage} {make(15)}" for _ in range(8)] + [make(40) for _ in range(20)]
    texts += ["É é ß 日本 " * 12, "É é ß 日本 " * 12 + "end"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    share_code(spark)
    rows = [(i, t, "en", "s", len(t or ""), 7, "clash") for i, t in enumerate(odd_texts())]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def fold(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(docs):
    rows, df = docs
    sets = {}
    for i, t, *_ in rows:
        w = fold(t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in chosen_path.near_duplicates(df).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_crowded_nodes_lose_no_link(docs, monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    test_near_duplicates_equal_brute_force(docs)


def test_crowd_on_one_template_keeps_its_pairs(spark, monkeypatch):
    share_code(spark)
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    template = [f"t{k}" for k in range(144)]
    rows = []
    for p in range(75):  # 150 of 200 shingles within a pair, 140 of 210 across
        shared = [f"s{p}x{k}" for k in range(10)]
        rows += [(2 * p + q, " ".join(template + shared + [f"u{p}x{q}x{k}" for k in range(25)])) for q in (0, 1)]
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_repeats_equal_brute_force(docs):
    rows, df = docs
    seen, want = set(), {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            gone |= set(range(s, s + 20)) if k in seen else set()
            seen.add(k)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.drop_repeats(df, digest=True).collect()}
    assert got == want


def test_crowded_seed_has_no_chance_matches():
    words = textscan.Words(pa.array([" ".join(f"h{k}" for k in range(100_000))]))
    places = np.arange(len(words.start) - 4)
    low = int(np.argmin(textscan.run_hash(textscan.run_sums(words.hashes()), places, places + 5)))
    hot = " ".join(f"h{low + k}" for k in range(5))
    n = 60_000  # texts that differ in every word but the seed's
    texts = [" ".join([*(f"a{i}x{k}" for k in range(15)), hot, *(f"b{i}x{k}" for k in range(15))]) for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    batch = batch.append_column("row", pa.array([0] * n, pa.int64()))
    rows = pa.Table.from_batches(substring_dedup._seed_rows([batch])).sort_by([("seed", "ascending"), ("doc_id", "ascending"), ("span", "ascending")])
    assert np.bincount(np.unique(rows.column("seed").to_numpy(), return_inverse=True)[1]).max() > 0.9 * n
    assert substring_dedup._judge(rows).num_rows == 0


def test_crowded_seeds_are_passed_on_whole(monkeypatch):
    rng = random.Random(9)
    common = " ".join(f"c{k}" for k in range(6))
    tail = lambda: [rng.choice([f"p{k}" for k in range(9)]) for _ in range(12)]
    sides = [[f"s{i}x{k}" for k in range(8)] for i in range(12)]
    texts = [" ".join([*tail(), *rng.choice(sides), common, *rng.choice(sides), *tail()]) for _ in range(900)]
    cols = {"doc_id": pa.array(range(900), pa.int64()), "row": pa.array([0] * 900, pa.int64()), "text": pa.array(texts)}
    rows = pa.Table.from_batches(substring_dedup._seed_rows([pa.RecordBatch.from_pydict(cols)])).sort_by([("seed", "ascending"), ("doc_id", "ascending"), ("span", "ascending")])

    def found():
        cut, met = {}, {}
        for batch in substring_dedup._repeats(iter(rows.to_batches(max_chunksize=37))):
            for r in batch.to_pylist():
                if r["key"] is None:
                    cut.setdefault((r["doc_id"], r["cut"] >> 16), 0)
                    cut[r["doc_id"], r["cut"] >> 16] |= r["cut"] & 0xFFFF
                else:
                    met.setdefault((r["key"], r["code"]), []).append((r["doc_id"], r["start"], r["cut"]))
        for group in met.values():
            for doc, start, one in group:
                if (doc, start) != min(group)[:2]:
                    cut[doc, one >> 16] = cut.get((doc, one >> 16), 0) | one & 0xFFFF
        return cut, len(met)

    want, passed = found()
    assert want and not passed
    monkeypatch.setattr(substring_dedup, "AHEAD", 100)
    got, passed = found()
    assert got == want and passed


def test_repeated_ids_with_other_texts(spark):
    """Each row keeps what its own text and place say, whatever rows share its doc_id."""
    share_code(spark)
    make = lambda name, n=60: [f"{name}{k}" for k in range(n)]
    near = lambda words: " ".join(words[:-2] + ["other", "end"])
    a, b = make("a"), make("b")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a)), (8, near(b)), (3, "x " + near(b)), (None, " ".join(make("n"))), (None, near(make("n"))), (5, "short"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept, r.first) for r in chosen_path.near_duplicates(df, extra=("row", "first")).collect()}
    assert got == {(5, 56, 5, True, True), (5, 56, 3, False, False), (7, 56, 5, False, False), (8, 56, 3, False, False), (3, 57, 3, True, True), (None, 56, None, None, True), (None, 56, None, None, False), (5, 1, 5, True, True), (9, 0, 9, True, True)}
    cut = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.drop_repeats(df).collect())
    assert cut == [(0, 60, 0), (0, 60, 0), (3, 61, 0), (5, 1, 0), (5, 60, 0), (5, 60, 58), (7, 60, 58), (8, 60, 60), (9, 0, 0)]


def test_vectors_that_share_an_id(spark):
    share_code(spark)
    one, two, far = [1.0, 0.0], [0.0, 1.0], [1.0, 0.0, 0.0]
    rows = [(1, one, 0), (1, None, 0), (2, two, 0), (2, one, 0), (4, two, 0), (6, far, 0), (7, [2.0, 0.0, 0.01], 0), (None, two, 0), (8, one, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in embed_cells.near_duplicates(df).collect())
    assert got == [(0, 2, 2), (1, 0, 1), (1, 1, 1), (2, 1, 1), (2, 2, 2), (4, 2, 2), (6, 1, 6), (7, 1, 6), (8, 0, 8)]


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"q{k}" for k in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    cut = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substring_dedup.drop_repeats(df).collect())
    assert cut == [(False, 1, 0), (False, 1, 0), (False, 2, 40), (True, 0, 0)]
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in chosen_path.near_duplicates(df).collect())
    assert kept[:3] == [(False, 1, 1), (False, 1, 1), (False, 2, 1)]
    assert scaled_sketch.fingerprints(df).count() == 4


@pytest.mark.parametrize("work", [chosen_path.near_duplicates, substring_dedup.drop_repeats, scaled_sketch.fingerprints])
def test_empty_tables(spark, work):
    assert work(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprints(docs):
    rows, df = docs
    got = {r.doc_id: r for r in scaled_sketch.fingerprints(df).collect()}
    for k, (i, t, *_) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + n[:cut]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if t == edited:
            assert got[i].fingerprint == got[i].edited_fingerprint and got[i].near_edited == 1
    same = {}
    for i, t, *_ in rows:
        assert same.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint
    assert np.mean([r.near_edited for r in got.values() if r.n_chars > 400]) > 0.6
    # Likeness is the share of the smaller sketch in the other, and near the containment of the full sets.
    kept = lambda f: {int(x, 16) for x in f.split(",")} if f else set()
    share = lambda a, b, same: len(a & b) / min(len(a), len(b)) if a and b else float(same)

    def full(text):
        w = text.encode().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    off = []
    for k, (i, t, *_) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1] or ""
        t, cut = t or "", len(t or "") // 4
        edited = t[: len(t) - cut] + n[:cut]
        mine, other = kept(got[i].fingerprint), kept(got[i].edited_fingerprint)
        assert all(h < (1 << 32) // scaled_sketch.SCALE for h in mine) and got[i].fingerprint == ",".join(sorted(got[i].fingerprint.split(",")))
        assert got[i].near_edited == pytest.approx(share(mine, other, t == edited))
        assert got[i].near_next == pytest.approx(share(mine, kept(got[rows[(k + 1) % len(rows)][0]].fingerprint), t == n))
        a, b = full(t), full(edited)
        if min(len(a), len(b)) > 60:
            off.append(got[i].near_edited - len(a & b) / min(len(a), len(b)))
    assert off and abs(np.mean(off)) < 0.05 and np.max(np.abs(off)) < 0.4


def test_ids_over_all_longs(spark):
    rng = random.Random(12)
    ids = sorted({-(2**63), 2**63 - 1, 0, *(rng.randrange(-(2**63), 2**63) for _ in range(2000)), *range(3000)})
    df = spark.createDataFrame([(i, f"text {i} of its own") for i in ids], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.edited_sha256 for r in scaled_sketch.fingerprints(df).collect()}
    for i, j in zip(ids, [*ids[1:], ids[0]]):
        t, n = f"text {i} of its own", f"text {j} of its own"
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest()


def test_sketch_is_native(docs):
    plan = scaled_sketch.fingerprints(docs[1])._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "Arrow"))


def vectors():
    rng = np.random.default_rng(3)
    out = []
    for label in (0, 1):
        centre = rng.normal(size=(12, 8))
        for c in centre:
            for _ in range(6):
                out.append((label, (c + rng.normal(size=8) * 0.12).tolist()))
    out += [(0, out[0][1])] * 3 + [(1, [2 * x for x in out[90][1]])]
    out += [(None, out[0][1]), (0, None), (0, [0.0] * 8), (0, [float("nan")] + [1.0] * 7), (1, [None] + [1.0] * 7), (1, [float("inf")] * 8), (1, [1.0, 2.0]), (5, [1.0] * 8)]
    return [(i, e, label, "clash") for i, (label, e) in enumerate(out)]


@pytest.mark.parametrize("block", [1024, 16])
def test_embedding_links_equal_brute_force(spark, monkeypatch, block):
    share_code(spark)
    monkeypatch.setattr(embed_cells, "BLOCK", block)
    rows = vectors()
    good = {}
    for i, e, label, _ in rows:
        if label is not None and e is not None and len(e) == 8 and all(x is not None and np.isfinite(x) for x in e) and any(e):
            good[i] = (label, np.array(e) / np.linalg.norm(e))
    links = [(a, b) for a, b in itertools.combinations(good, 2) if good[a][0] == good[b][0] and good[a][1] @ good[b][1] >= 0.98]
    want = roots([r[0] for r in rows], links)
    count = {i: sum(i in pair for pair in links) for i, *_ in rows}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_cells.near_duplicates(df).collect()}
    assert links and got == {i: (count[i], want[i], want[i] == i) for i, *_ in rows}


def test_no_vectors(spark):
    assert embed_cells.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
