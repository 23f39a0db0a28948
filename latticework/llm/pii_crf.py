"""Personal data by exact patterns plus a conditional random field over word shapes.

Base spans follow fixed patterns (email, ip, card with Luhn, phone), leftmost and
without overlap in each kind.  The field adds spans: words are labelled by
Viterbi from features of their shape (counts of digits, letters and marks, first
and last class, cue words) and of both neighbours.  It is trained on a small
labelled table, which is a parameter; the built-in one is written from templates.

Added spans never overlap base ones, and an added card, phone, email or ip must
still look like one (a card must pass Luhn), so that ordinary prose stays untouched.

Sequences are lines.  They are decoded in pieces that end at words which are
outside any span on every best path, whatever stands beside them; that is known
from their scores and those of the next word, so the pieces' paths together are
the line's.

Defined cases: null text is empty and has no spans; spans count code points, end
exclusive; repeated rows give repeated results; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .textscan import Words, slices

KINDS = ("email", "ip", "card", "phone")
MORE = ("id", "secret")
STATES = ("O", "B-email", "B-ip", "B-card", "I-card", "B-phone", "I-phone", "B-id", "I-id", "B-secret")
KIND_OF = ("", "email", "ip", "card", "card", "phone", "phone", "id", "id", "secret")
INSIDE = np.array([s.startswith("I-") for s in STATES])
LINE = 32
CUES = ("tel", "phone", "call", "mobile", "fax", "card", "visa", "iban", "ssn", "id", "passport", "token", "secret", "password", "api_key", "key", "apikey")

_AT = re.compile("@")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, in linear time, by start and then kind."""
    out = []
    done = 0
    for m in _AT.finditer(text) if "@" in text else ():
        if m.start() < done:
            continue
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (found := _EMAIL.match(text, start)):
            done = found.end()
            out.append((start, 0, done))
    for m in _DOTTED.finditer(text):
        parts = list(_DIGITS.finditer(text, m.start(), m.end()))
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(p.group().lstrip("0")) <= 3 and int(p.group()[-4:]) <= 255 for p in four):
                out.append((four[0].start(), 1, four[3].end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return [(s, KINDS[k], e) for s, k, e in out]


# Word shapes ---------------------------------------------------------------

_CLASSES = {"lower": 1, "upper": 2, "digit": 3, "@": 4, ".": 5, "-": 6, "+": 7, "(": 8, ")": 8, "=": 9, ":": 9, '"': 10, "'": 10, "_": 11, "/": 11, "%": 11}
_CLASS = np.full(256, 12, np.uint8)
for _c in range(128):
    _ch = chr(_c)
    _CLASS[_c] = 1 if _ch.islower() else 2 if _ch.isupper() else 3 if _ch.isdigit() else _CLASSES.get(_ch, 12)
_CLASS[128:] = 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 0


def _field(classes: list[tuple[int, ...]]) -> np.ndarray:
    """Byte to four 16-bit counters in one integer."""
    out = np.zeros(256, np.uint64)
    for k, group in enumerate(classes):
        for c in group:
            out[_CLASS == c] += np.uint64(1 << 16 * k)
    return out


_COUNT_A = _field([(1,), (2,), (3,), (12,)])
_COUNT_B = _field([(4,), (5,), (6,), (7, 8)])
_COUNT_C = _field([(9,), (10,), (11,)])
_DIGIT_BIN = np.minimum(np.searchsorted([1, 2, 3, 4, 5, 7, 10, 13, 14, 15, 17, 20], np.arange(65536), "right"), 12).astype(np.int16)
_LETTER_BIN = np.searchsorted([1, 3, 8, 16, 32], np.arange(65536), "right").astype(np.int16)
FIELDS = (13, 6 * 3, 3 * 5, 4 * 3, 8, 3 * 13, 13 * 13, len(CUES) + 1)
CONTEXT = 13 * 3 * (len(CUES) + 1)
SIZES = [*FIELDS, CONTEXT, CONTEXT]


@lru_cache(maxsize=1)
def _cue_hashes() -> tuple[np.ndarray, np.ndarray]:
    forms = [(c + end, k + 1) for k, c in enumerate(CUES) for end in ("", ":", "=", ".", "#")]
    codes = Words(pa.array([" ".join(f for f, _ in forms)])).hashes(folded=True)
    order = np.argsort(codes)
    return codes[order], np.array([k for _, k in forms])[order]


def shapes(words: Words) -> list[np.ndarray]:
    """Feature codes of each word; neighbours outside the text count as code 0."""
    data, start, end = words.data, words.start, words.end
    if not len(start):
        return [np.zeros(0, np.int64)] * len(SIZES)
    a, b, c = (np.add.reduceat(t[data], start) for t in (_COUNT_A, _COUNT_B, _COUNT_C))
    part = lambda x, k: ((x >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
    lower, upper, digit, other = (part(a, k) for k in range(4))
    at, dot, dash, plus = (part(b, k) for k in range(4))
    eq, quote, slash = (part(c, k) for k in range(3))
    for w in np.flatnonzero(end - start > 60_000):  # beyond what the packed counters hold
        n = np.bincount(_CLASS[data[start[w] : end[w]]], minlength=13)
        lower[w], upper[w], digit[w], other[w], at[w], dot[w], dash[w] = n[[1, 2, 3, 12, 4, 5, 6]]
        plus[w], eq[w], quote[w], slash[w] = n[7] + n[8], n[9], n[10], n[11]
    first, last = _CLASS[data[start]].astype(np.int64), _CLASS[data[end - 1]].astype(np.int64)
    case = np.where(upper == 0, 0, np.where(lower == 0, 2, 1))
    digits = _DIGIT_BIN[np.minimum(digit, 65535)].astype(np.int64)
    hashes, cue_ids = _cue_hashes()
    codes = words.hashes(folded=True)
    near = np.minimum(np.searchsorted(hashes, codes), len(hashes) - 1)
    cue = np.where(hashes[near] == codes, cue_ids[near], 0)
    kind = np.where((digit == 0) & (at == 0), 0, np.where(lower + upper == 0, 1, 2))
    about = (digits * 3 + kind) * (len(CUES) + 1) + cue
    before, after = np.zeros_like(about), np.zeros_like(about)
    before[1:], after[:-1] = about[:-1], about[1:]
    edge = words.first[:-1][words.counts > 0]
    before[edge] = 0
    after[edge[1:] - 1] = 0
    return [
        digits,
        _LETTER_BIN[np.minimum(lower + upper, 65535)].astype(np.int64) * 3 + case,
        np.minimum(at, 2) * 5 + np.minimum(dot, 4),
        np.minimum(plus, 3) * 3 + np.minimum(dash, 2),
        np.minimum(eq, 1) * 4 + np.minimum(quote, 1) * 2 + np.minimum(slash, 1),
        np.searchsorted([1, 3], other, "right") * 13 + digits,
        first * 13 + last,
        cue,
        before,
        after,
    ]


def line_starts(words: Words) -> np.ndarray:
    """Whether a word is the first of its line."""
    new = np.zeros(len(words.start), bool)
    new[words.first[:-1][words.counts > 0]] = True
    breaks = np.concatenate([[0], np.cumsum(words.data == 10)])
    new[1:] |= breaks[words.start[1:]] > breaks[words.end[:-1]]
    return new


def outside(emit: np.ndarray, move: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Words that every best path leaves outside, whatever its states before and behind.

    A path with state s at a word is compared with the one that is outside there
    and else the same, but for an inner state behind it, which becomes the first
    of its kind.  The word is surely outside if the change is a gain for every s,
    every state before and every one behind.
    """
    n, k = emit.shape
    sure, after = np.ones(n, bool), np.vstack([emit[1:], np.zeros((1, k), emit.dtype)])
    inner = {STATES.index(x): STATES.index("B" + x[1:]) for x in STATES if x.startswith("I-")}
    for s in range(1, k):
        came = min(float((move[:, 0] - move[:, s]).min()), float(begin[0] - begin[s]))
        gone = np.full(n, min([0.0, *(float(move[0, b] - move[s, b]) for b in range(k) if b not in inner)]))
        for i, first in inner.items():
            if move[s, i] > -1e3:
                then = min(0.0, float((move[first] - move[i]).min()))
                gone = np.minimum(gone, float(move[0, first] - move[s, i]) + after[:, first] - after[:, i] + then)
        sure &= emit[:, 0] - emit[:, s] + came + gone > 1e-3
    return sure


def decode(emit: np.ndarray, move: np.ndarray, begin: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Viterbi states of lines (``new`` marks their first words), cut at sure words about every ``LINE``."""
    n = len(emit)
    sure = np.flatnonzero(outside(emit, move, begin)[:-1] & ~new[1:])
    cut = sure[np.diff(sure // LINE, prepend=-1) > 0]
    emit, piece = emit.copy(), new.copy()
    emit[cut, 1:] = -1e9
    emit[cut + 1] += move[0] - begin
    piece[cut + 1] = True
    first = np.flatnonzero(piece)
    return crf.viterbi(emit, move, begin, crf.Layout(first, np.diff(np.append(first, n))))


# Training table ------------------------------------------------------------


def labelled_table(rows: int = 700, seed: int = 3) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: words and states of made-up lines."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    syllables = "er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ch ung keit ción é ü ß".split()
    name = lambda: "".join(rng.choice(syllables[:28]) for _ in range(rng.randint(1, 4)))

    def filler() -> list[str]:
        w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
        w = rng.choice([w] * 6 + [w.capitalize(), w.upper(), w + ",", w + ".", w + "!!", w + "$$$", w + "###", w + "&&&", "|", w + "%%%", w + "***"])
        if rng.random() < 0.07:
            w = rng.choice([str(rng.randint(1, 3000)), f"{rng.randint(1, 99)}.{digits(2)}", f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}", f"{rng.randint(1, 9)}.{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"{digits(1)},{digits(3)}", f"(c)", f"v{digits(1)}", f"{digits(2)}%", f"#{digits(3)}", "version", "3."])
        return [w]

    def entity() -> tuple[list[str], str]:
        kind = rng.choice(["email", "ip", "card", "phone", "id", "secret"])
        if kind == "email":
            words = [f"{name()}{rng.choice(['', '.', '_'])}{name()}{rng.choice(['', digits(2)])}@{name()}.{rng.choice(['com', 'org', 'net', 'de', 'co.uk'])}"]
        elif kind == "ip":
            words = [".".join(str(rng.randint(0, 255)) for _ in range(4))]
        elif kind == "card":
            g = [digits(4) for _ in range(4)]
            words = rng.choice([["".join(g)], ["-".join(g)], g])
        elif kind == "phone":
            words = rng.choice([[f"+{digits(2)}", digits(3), digits(7)], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"+1-{digits(3)}-{digits(3)}-{digits(4)}"], [f"+{digits(11)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"]])
        elif kind == "id":
            words = rng.choice([[f"{digits(3)}-{digits(2)}-{digits(4)}"], [f"{rng.choice(['DE', 'FR', 'ES'])}{digits(2)}", *[digits(4) for _ in range(4)], digits(2)], [f"{rng.choice(['DE', 'FR'])}{digits(20)}"]])
        else:
            words = [rng.choice([f'"{hexes(40)}"', hexes(40), hexes(32), "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)), f"sk_live_{hexes(24)}", f"ghp_{hexes(36)}"])]
        end = rng.choice(["", "", "", ".", ",", "###", "$$$"])
        words[-1] += end
        if rng.random() < 0.2:
            words[0] = rng.choice(["(", '"', "<"]) + words[0]
        return words, kind

    cues = {"email": ["mail"], "ip": ["host"], "card": ["card", "visa"], "phone": ["tel:", "phone", "call"], "id": ["ssn", "iban"], "secret": ["token =", "api_key:", "secret", "password ="]}
    table = []
    for _ in range(rows):
        words, states = [], []
        for _ in range(rng.randint(2, 9)):
            if rng.random() < 0.25:
                found, kind = entity()
                if rng.random() < 0.5:
                    cue = rng.choice(cues[kind]).split()
                    words, states = words + cue, states + ["O"] * len(cue)
                words += found
                states += [f"B-{kind}"] + [f"I-{kind}"] * (len(found) - 1)
            else:
                for _ in range(rng.randint(1, 3)):
                    words += filler()
                    states += ["O"]
        table.append((words, states))
    return table


@lru_cache(maxsize=1)
def default_model():
    return fit(labelled_table())


def fit(table: list[tuple[list[str], list[str]]], epochs: int = 50):
    """Feature tables, moves and begins learned from (words, states) rows."""
    words = Words(pa.array([" ".join(w) for w, _ in table]))
    gold = np.array([STATES.index(s) for _, states in table for s in states])
    codes = shapes(words)
    everyone = [np.arange(len(gold))] * len(codes)
    tables, move, begin = crf.train(codes, SIZES, everyone, gold, crf.Layout(words.first[:-1], words.counts), len(STATES), epochs)
    for kind in {k for k in KIND_OF if k}:  # an inner state follows its own kind only
        for j, s in enumerate(STATES):
            if s == f"I-{kind}":
                begin[j] = -1e4
                for i in range(len(STATES)):
                    if KIND_OF[i] != kind:
                        move[i, j] = -1e4
    return tables, move, begin


def _fits(kind: str, span: str) -> bool:
    digits = sum(c.isdigit() and c.isascii() for c in span)
    if kind == "email":
        return "@" in span
    if kind == "ip":
        return span.count(".") == 3 and digits >= 4 or span.count(":") >= 3
    if kind == "card":
        return 13 <= digits <= 19 and luhn(_NOT_DIGIT.sub("", span))
    if kind == "phone":
        return 7 <= digits <= 15
    if kind == "id":
        return 9 <= digits <= 30
    return len(span) >= 16 and digits >= 3


def field_spans(words: Words, texts: list[str], model) -> list[list[tuple[int, str, int]]]:
    """Spans that the field labels in each text."""
    tables, move, begin = model
    out: list[list[tuple[int, str, int]]] = [[] for _ in texts]
    n = len(words.start)
    if not n:
        return out
    codes = shapes(words)
    emit = tables[0][codes[0]]
    for t, c in zip(tables[1:], codes[1:]):
        emit += t[c]
    new = line_starts(words)
    states = decode(emit, move, begin, new)
    head = np.flatnonzero((states > 0) & (~INSIDE[states] | new))
    if not len(head):
        return out
    inside = INSIDE[states] & ~new
    stop = np.append(np.flatnonzero(~inside), n)
    tail = stop[np.searchsorted(stop, head, "right")] - 1
    points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    doc = np.searchsorted(words.first, head, "right") - 1
    for d, h, t in zip(doc.tolist(), head.tolist(), tail.tolist()):
        zero = points[words.at[d]]
        s, e = int(points[words.start[h]] - zero), int(points[words.end[t]] - zero)
        text, kind = texts[d], KIND_OF[states[h]]
        opening = "+(" if kind == "phone" else ""
        while s < e and not (text[s].isalnum() or text[s] in opening):
            s += 1
        while e > s and not text[e - 1].isalnum():
            e -= 1
        if _fits(kind, text[s:e]):
            out[d].append((s, kind, e))
    return out


def all_spans(texts: list[str], words: Words, model) -> list[tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]]:
    """Base spans, and base plus added ones, of each text."""
    rank = {k: i for i, k in enumerate((*KINDS, *MORE))}
    out = []
    for text, added in zip(texts, field_spans(words, texts, model)):
        base = base_spans(text)
        merged, covered = list(base), []
        for s, _, e in sorted(base):
            if covered and s <= covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], e)
            else:
                covered.append([s, e])
        begins = [s for s, _ in covered]
        for s, kind, e in added:
            at = bisect_right(begins, s)
            if not (at and covered[at - 1][1] > s or at < len(covered) and covered[at][0] < e):
                merged.append((s, kind, e))
        merged.sort(key=lambda x: (x[0], rank[x[1]], x[2]))
        out.append((base, merged))
    return out


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, done = [], 0
    for s, kind, e in spans:
        if s >= done:
            out += [text[done:s], f"[{kind}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def _texts(part: pa.RecordBatch) -> list[str]:
    return [t or "" for t in part.column("text").to_pylist()]


def find_personal_data(docs: DataFrame, model=None) -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = all_spans(_texts(part), Words(part.column("text")), shared.value)
                counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *[pa.array(c, pa.int64()) for c in counts],
                        pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()),
                        pa.array([written(every) for _, every in found], pa.string()),
                        pa.array([len(every) - len(base) for base, every in found], pa.int64()),
                    ],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def mask_personal_data(docs: DataFrame, model=None) -> DataFrame:
    """``docs`` with spans masked in text and n_chars recounted; null texts stay null, other columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = _texts(part)
                found = all_spans(texts, Words(part.column("text")), shared.value)
                null = part.column("text").is_null().to_pylist()
                new = [None if z else masked(t, every) for t, (_, every), z in zip(texts, found, null)]
                put = {"text": pa.array(new, part.schema.field("text").type)}
                if "n_chars" in part.schema.names:
                    size = part.schema.field("n_chars").type
                    put["n_chars"] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(size)
                yield pa.RecordBatch.from_arrays([put.get(n, part.column(n)) for n in part.schema.names], names=part.schema.names)

    return docs.mapInArrow(run, schema)
