"""Language of documents by a conditional random field over their words.

A word is a run of letters.  Its features are hashed: the word itself (the
lexicon of the training texts), prefixes and suffixes of two and three letters,
and letter pairs and triples with word edges.  Moves between the languages of
neighbouring words are learned, so a switch costs evidence.  Forward-backward
gives each word a posterior; a document's languages are the means of these,
weighted by letters, and the largest is predicted.

A chain is the whole text, however long: blocks of it are worked on side by side
and what they carry over is exact.  Training uses a bounded sample (``SAMPLE``
documents a language, of at most ``LONGEST`` characters, of the ``MOST_LANGUAGES``
languages with most documents) outside the held-out fold; besides the documents
themselves it is shown texts joined of stretches of several of them, so that
moves are learned from switches too.

Defined cases: null text, or text without letters, is ``und`` with score 0;
repeated rows are predicted alike; with no labelled text everything is ``und``;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .sampling import bucket
from .textscan import mix, powers, slices

SAMPLE = 120
LONGEST = 100_000
MOST_LANGUAGES = 64
BLOCK = 64
STRETCH = (3, 24)
EPOCHS = 12
BITS = 15
SIZE = 1 << BITS


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Folded code of each code point, 0 where it is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _hash(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)


class LetterWords:
    """Runs of letters of several texts and their hashed features."""

    def __init__(self, texts: list[str]):
        size = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = letters()[raw].astype(np.uint64)
        at = np.concatenate([[0], np.cumsum(size + 1)])
        isl = np.concatenate([[False], code > 0, [False]])
        self.start = np.flatnonzero(isl[1:-1] & ~isl[:-2])
        self.end = np.flatnonzero(isl[1:-1] & ~isl[2:]) + 1
        self.length = self.end - self.start
        self.first = np.searchsorted(self.start, at)
        self.code = np.concatenate([code, np.zeros(3, np.uint64)])
        self.before = np.concatenate([np.zeros(1, np.uint64), self.code[:-1]])

    def features(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Codes, and the words that own them, by kind of feature."""
        c, s, e = self.code, self.start, self.end
        n = len(s)
        if not n:
            return [np.zeros(0, np.int32)] * 6, [np.zeros(0, np.int64)] * 6
        up, down = powers(len(c) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * up[: len(c)])])
        whole = _hash(mix((sums[e] - sums[s]) * down[s]))
        a, b = c[s], c[s + 1]
        y, z = c[e - 1], self.before[e - 1]
        third = np.where(self.length > 2, c[np.minimum(s + 2, len(c) - 1)], np.uint64(0))
        x = np.where(self.length > 2, self.before[np.maximum(e - 2, 0)], np.uint64(0))
        two, three = np.uint64(1 << 21), np.uint64(1 << 42)
        prefix, suffix = _hash((a + b * two) * np.uint64(2) + np.uint64(1)), _hash((y + z * two) * np.uint64(5) + np.uint64(3))
        prefix3, suffix3 = _hash((a + b * two + third * three) * np.uint64(7)), _hash((y + z * two + x * three) * np.uint64(11))
        owner = np.repeat(np.arange(n), self.length)
        pos = np.arange(len(owner)) - np.repeat(np.cumsum(self.length) - self.length, self.length) + s[owner]
        p, q, r = self.before[pos], c[pos], c[pos + 1]
        grams = _hash((p + q * two + r * three) * np.uint64(13))
        every = np.arange(n)
        return [whole, prefix, suffix, prefix3, suffix3, grams], [every] * 5 + [owner]

    def emissions(self, tables: list[np.ndarray]) -> np.ndarray:
        codes, _ = self.features()
        n = len(self.start)
        if not n:
            return np.zeros((0, tables[0].shape[1]), np.float32)
        emit = tables[0][codes[0]]
        for t, x in zip(tables[1:5], codes[1:5]):
            emit += t[x]
        begin = np.cumsum(self.length) - self.length
        grams = codes[5]
        for j in range(emit.shape[1]):
            emit[:, j] += np.add.reduceat(np.ascontiguousarray(tables[5][:, j])[grams], begin)
        return emit

    def layout(self) -> crf.Layout:
        """Training chains: blocks of ``BLOCK`` words."""
        count = np.diff(self.first)
        blocks = (count + BLOCK - 1) // BLOCK
        before = np.cumsum(blocks) - blocks
        inner = np.arange(int(blocks.sum())) - np.repeat(before, blocks)
        first = np.repeat(self.first[:-1], blocks) + inner * BLOCK
        return crf.Layout(first, np.minimum(BLOCK, np.repeat(self.first[1:], blocks) - first))


class Languages:
    def __init__(self, names: list[str], tables: list[np.ndarray], move: np.ndarray, begin: np.ndarray):
        self.names, self.tables, self.move, self.begin = names, tables, move, begin

    def words(self, texts: list[str]) -> tuple[LetterWords, np.ndarray]:
        """The words of the texts and each one's posterior over languages."""
        words = LetterWords(texts)
        return words, crf.long_marginals(words.emissions(self.tables), self.move, self.begin, words.first[:-1], np.diff(words.first), BLOCK)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        words, post = self.words(texts)
        total = np.zeros((len(texts), len(self.names)))
        has = np.flatnonzero(np.diff(words.first))
        if len(has):
            total[has] = np.add.reduceat(post * words.length[:, None], words.first[has], axis=0)
        weight = total.sum(1)
        best = total.argmax(1)
        score = np.where(weight > 0, total[np.arange(len(texts)), best] / np.where(weight > 0, weight, 1), 0.0)
        return [self.names[k] if w > 0 else "und" for k, w in zip(best.tolist(), weight.tolist())], np.clip(score, 0, 1)


def switched(texts: list[str], langs: list[str], count: int, seed: int = 4) -> list[tuple[str, list[str]]]:
    """``count`` texts joined of stretches of several texts, and the language of each of their words."""
    rng, out = random.Random(seed), []
    split = [(t.split(), x) for t, x in zip(texts, langs)]
    split = [(w, x) for w, x in split if w]
    for _ in range(count if split else 0):
        parts, gold = [], []
        for _ in range(rng.randint(2, 5)):
            words, lang = rng.choice(split)
            at = rng.randrange(len(words))
            part = " ".join(words[at : at + rng.randint(*STRETCH)])
            parts.append(part)
            gold += [lang] * len(LetterWords([part]).start)
        out.append((" ".join(parts), gold))
    return out


def fit(texts: list[str], langs: list[str]) -> Languages:
    names = sorted(set(langs))
    mixed = switched(texts, langs, len(texts) if len(names) > 1 else 0)
    words = LetterWords([*texts, *(t for t, _ in mixed)])
    if not len(words.start):
        return Languages([], [], np.zeros((0, 0)), np.zeros(0))
    plain = np.repeat(np.array([names.index(x) for x in langs], np.int64), np.diff(words.first)[: len(texts)])
    gold = np.concatenate([plain, np.array([names.index(x) for _, g in mixed for x in g], np.int64)])
    codes, owner = words.features()
    tables, move, begin = crf.train(codes, [SIZE] * 6, owner, gold, words.layout(), len(names), EPOCHS, rate=0.1, decay=1e-3)
    return Languages(names, tables, move, begin)


def held_out():
    return bucket(4) == 2


def learn(docs: DataFrame) -> Languages:
    """A field fitted on about ``SAMPLE`` documents a language outside the held-out fold."""
    known = docs.where("lang is not null and doc_id is not null").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    known = known.where(F.length("text") <= LONGEST)
    counts = known.groupBy("lang").agg(F.count("*").alias("class_rows")).orderBy(F.desc("class_rows"), "lang").limit(MOST_LANGUAGES)
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_003)) / 1_000_003.0
    rows = known.join(F.broadcast(counts), "lang").where(drawn < SAMPLE / F.col("class_rows"))
    got = sorted((r.lang, r.doc_id, r.text) for r in rows.select("doc_id", "lang", "text").distinct().collect())
    return fit([t for _, _, t in got], [x for x, _, _ in got])


def predict_languages(docs: DataFrame, model: Languages) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names, score = shared.value.predict([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return given.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
