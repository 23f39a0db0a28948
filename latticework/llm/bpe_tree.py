"""BPE encoding by a segment tree over the ranks of adjacent pairs.

The leaves of a word's tree are the merge ranks of its adjacent symbol pairs;
inner nodes hold the smaller child.  The root is thus the lowest rank, and going
down to the left first finds its leftmost pair.  A merge changes three leaves
and their paths.  Trees of equal width are worked on together, one merge in each
at a time, as numpy arrays; a worker keeps the results of recent words.  In a
tree of more than ``TALL`` leaves all merges of the root's rank that do not overlap
are done in one step where their symbol is in no pair of lower rank, so that
the order makes no difference; so a long unbroken run takes a step a rank.

The vocabulary file is a parameter.  Its pieces used here: NFC, white space runs
to one space, lower case, the splitting pattern, byte symbols with a word end
mark, and no decoder (decoding joins token strings by spaces).

Defined cases: null text is empty and gives no ids; the strings of the special
tokens give their ids; repeated rows give repeated results; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from .textscan import give_back, slices

NONE = np.int32(2**31 - 1)
CELLS = 1 << 19
TALL = 1 << 11
#: Here the library's letters follow an older Unicode version; its own splitter then cuts the words.
NEWER = regex.compile("[\u0558-\u1fff\u208f-\u209f\ua7c0-\U0010ffff]")
REMEMBERED = 120_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class PairTreeBPE:
    """The encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*vocab.items(), *special.items()]}
        self.special = special
        self.mark = os.path.commonprefix(list(special))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        self.normalizer, self.splitter = Tokenizer.from_file(path).normalizer, pre_tokenizers.Split(Regex(pattern), "removed", True)
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs.append((vocab[a] << 20 | vocab[b], rank, vocab[a + b]))
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.ranks = np.array([p[1] for p in pairs], np.int32)
        self.merged = np.zeros(len(pairs), np.int64)
        self.merged[self.ranks] = [p[2] for p in pairs]
        #: The lowest rank of a pair that a merge's symbol is in.
        floor = np.full(max(vocab.values()) + 1, NONE, np.int32)
        np.minimum.at(floor, self.keys >> 20, self.ranks)
        np.minimum.at(floor, self.keys & 0xFFFFF, self.ranks)
        self.floor = floor[self.merged]
        self.known: dict[str, tuple[bytes, str]] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (its UTF-8 bytes, at least one)."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        size = np.array([len(w) for w in words])
        width = 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(int)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w > TALL:
                for r in rows.tolist():
                    out[r] = self._tall(words[r], int(w))
                continue
            step = max(1, CELLS // int(w))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for r, ids in zip(part.tolist(), self._forest([words[r] for r in part], size[part], int(w))):
                    out[r] = ids
        return out

    def _forest(self, words: list[bytes], size: np.ndarray, width: int) -> list[np.ndarray]:
        m, w = len(words), width
        raw = np.zeros((m, w), np.uint8)
        inside = np.arange(w) < size[:, None]
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        symbol = np.where(inside, self.inner[raw], -1)
        symbol[np.arange(m), size - 1] = self.last[raw[np.arange(m), size - 1]]
        tree = np.full((m, 2 * w), NONE, np.int32)
        pair = inside[:, 1:]
        leaf = np.full((m, w), NONE, np.int32)
        leaf[:, :-1][pair] = self.rank(symbol[:, :-1][pair], symbol[:, 1:][pair])
        tree[:, w:] = leaf
        level = w
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.tile(np.arange(1, w + 1), (m, 1))
        before = np.tile(np.arange(-1, w - 1), (m, 1))
        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            node, low = np.ones(len(row), np.int64), tree[row, 1]
            for _ in range(w.bit_length() - 1):
                node = 2 * node
                node += tree[row, node] != low
            i = node - w
            j = after[row, i]
            k = after[row, j]
            symbol[row, i] = new = self.merged[low]
            symbol[row, j] = -1
            after[row, i] = k
            h = before[row, i]
            has_right, has_left = k < size[row], h >= 0
            before[row[has_right], k[has_right]] = i[has_right]
            right, left = np.full(len(row), NONE, np.int32), np.full(len(row), NONE, np.int32)
            right[has_right] = self.rank(new[has_right], symbol[row[has_right], k[has_right]])
            left[has_left] = self.rank(symbol[row[has_left], h[has_left]], new[has_left])
            tree[row, j + w] = NONE
            tree[row, i + w] = right
            tree[row[has_left], h[has_left] + w] = left[has_left]
            at = np.stack([i, j, np.where(has_left, h, i)], 1) + w
            rows = row[:, None]
            for _ in range(w.bit_length() - 1):
                at >>= 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            row = row[tree[row, 1] != NONE]
        live = symbol >= 0
        flat = symbol[live].astype(np.uint32)
        return np.split(flat, np.cumsum(live.sum(1))[:-1])

    def _tall(self, word: bytes, w: int) -> np.ndarray:
        """Ids of one long word, by a tree of ``w`` leaves."""
        size = len(word)
        symbol = self.inner[np.frombuffer(word, np.uint8)]
        symbol[-1] = self.last[word[-1]]
        tree = np.full(2 * w, NONE, np.int32)
        tree[w : w + size - 1] = self.rank(symbol[:-1], symbol[1:])
        level = w
        while level > 1:
            tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
            level //= 2
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        while (low := tree[1]) != NONE:
            every = self.floor[low] > low
            i = np.ones(1, np.int64)
            while i[0] < w:  # to all leaves of the root's rank, or the first
                i = np.repeat(2 * i, 2) + np.tile([0, 1], len(i))
                i = i[tree[i] == low]
                i = i if every else i[:1]
            i -= w
            # Of pairs that overlap (the second symbol of one is the first of the next) each other one merges.
            chained = np.zeros(len(i), bool)
            chained[1:] = after[i[:-1]] == i[1:]
            head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(i))))
            i = i[(np.arange(len(i)) - head) % 2 == 0]
            j = after[i]
            k = after[j]
            symbol[i], symbol[j], after[i] = self.merged[low], -1, k
            before[k[k < size]] = i[k < size]
            h = before[i]
            right, left = i[k < size], i[h >= 0]
            tree[j + w] = tree[i + w] = NONE
            tree[right + w] = self.rank(symbol[right], symbol[after[right]])
            tree[before[left] + w] = self.rank(symbol[before[left]], symbol[left])
            at = np.concatenate([i, j, before[left]]) + w
            while at[0] > 1:
                at = np.unique(at >> 1)
                tree[at] = np.minimum(tree[2 * at], tree[2 * at + 1])
        return symbol[symbol >= 0].astype(np.uint32)

    def pieces(self, text: str) -> list[str]:
        """Words of the text in order; the strings of special tokens stand for themselves behind a zero byte."""
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text) if self.cut and self.mark in text else [text]):
            if k % 2:
                out.append("\0" + part)
            elif NEWER.search(part):
                out += [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))]
            else:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                out += self.split.findall(part.lower())
        return out

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*texts) - self.known.keys())
        plain = [w for w in new if w[0] != "\0" or w[1:] not in self.special]
        for w, ids in zip(plain, self.merge_words([w.encode() for w in plain])):
            self.known[w] = ids.tobytes(), " ".join([self.names[i] for i in ids.tolist()])
        for w in new:
            if w not in self.known:
                self.known[w] = self.special[w[1:]].to_bytes(4, "little"), w[1:]

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Of each text: ids as little-endian 32-bit integers, and their decoding."""
        words = [self.pieces(t) for t in texts]
        self.learn(words)
        known, out = self.known, []
        for w in words:
            got = [known[x] for x in w]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got])))
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> PairTreeBPE:
    return PairTreeBPE(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, keep: bool = False) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep`` also ids and decoded text.

    ``path`` must be readable where executors run; each worker reads it once.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for part in slices(batch):
                got = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                cols = [
                    part.column("doc_id"),
                    pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in got], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in got], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    cols += [pa.array([np.frombuffer(i, np.uint32).astype(np.int32) for i, _ in got], pa.list_(pa.int32())), pa.array([d for _, d in got], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        bpe.known.clear()
        give_back()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
