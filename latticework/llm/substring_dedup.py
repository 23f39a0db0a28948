"""Removing passages that repeat: winnowed seeds, extended both ways.

A seed is a run of five words.  Each window of twenty words holds sixteen seeds
and is owned by the one of smallest hash (the last of equals), so the same
twenty words have the same seed at the same place wherever they stand.  A seed
thus owns a run of windows: its matches extended left and right, by fifteen
words in all.  Occurrences of a seed meet once, in text order; of the windows
that extend them alike, all but the first are repeats, and windows that overlap
join to maximal repeats.  A window is known by 64 bits of its seed, the place in
it and 64 further bits of all its words.

Before they meet, each batch of documents keeps one occurrence of each extended
run and marks the others as repeats itself, so a passage of a third of all
documents sends a row a batch.  A seed of more than ``AHEAD`` occurrences that
extend differently (a very common phrase) is not held in memory: its windows are
passed on and meet by their own words, in partial aggregates.  No pair of
documents is formed.

Defined cases: null or blank text has no words; a text under twenty words loses
none; rows that repeat a doc_id, with the same or another text, are one document
in the order of texts, so of windows that start at the same word of them none
counts as earlier; a row with null doc_id takes no part and keeps its words;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import stable, with_totals, written
from .textscan import Words, mix, run_hash, run_sums, slices, windows

WINDOW = 20
SEED = 5
_LOW = (1 << 24) - 1
AHEAD = 200_000
JUDGED = ["doc_id", "row", "cut", "start", "key", "code"]


def _runs(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of each seed's run of windows: seed hash, hash of the run, row, first word, place of the seed in it, windows, and all windows' codes."""
    words = Words(part.column("text"))
    sums = run_sums(words.hashes())
    start, count = windows(words.first, WINDOW)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none, none.astype(np.uint64)
    total, spread = len(words.start), WINDOW - SEED + 1
    seeds = run_hash(sums, np.arange(total - SEED + 1), np.arange(SEED, total + 1))
    low = (seeds & ~np.uint64(_LOW)) | (np.uint64(_LOW) - (np.arange(len(seeds)).astype(np.uint64) & np.uint64(_LOW)))
    step = 1
    while step < spread:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    chosen = _LOW - (low[start] & np.uint64(_LOW)).astype(np.int64)
    if total > _LOW:  # one very long text: places are modulo 2**24
        chosen += (start - chosen + _LOW) // (_LOW + 1) * (_LOW + 1)
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(start)))
    first = start[at]
    row = np.searchsorted(words.first, first, "right") - 1
    codes = run_hash(sums, start, start + WINDOW)
    whole = run_hash(sums, first, first + n - 1 + WINDOW)
    return seeds[chosen[at]], whole, row, first - words.first[row], chosen[at] - first, n, codes


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(batch.column("doc_id").is_valid())
        got = [(part.column("doc_id").to_numpy(zero_copy_only=False), part.column("row").to_numpy(), _runs(part)) for part in slices(batch)]
        if not got:
            continue
        doc, number = np.concatenate([ids[r[2]] for ids, _, r in got]), np.concatenate([rows[r[2]] for _, rows, r in got])
        seed, whole, _, first, place, n, codes = (np.concatenate([r[k] for _, _, r in got]) for k in range(7))
        if not len(seed):
            continue
        order = np.lexsort((first, doc, whole))
        same = np.zeros(len(order), bool)
        same[1:] = whole[order[1:]] == whole[order[:-1]]
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        repeat = np.zeros(len(order), bool)
        repeat[order] = (doc[order] != doc[order[head]]) | (first[order] != first[order[head]])
        ends = np.zeros(len(n) + 1, np.int32)
        np.cumsum(np.where(repeat, 0, n) * 8, out=ends[1:])
        kept = codes[np.repeat(~repeat, n)]
        span = (first << 10) | (place << 5) | (n - 1)
        payload = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(kept))])
        key = np.where(repeat, (whole ^ doc.view(np.uint64)), seed)  # marked repeats need not meet
        for k in range(0, len(n), 50_000):
            cut = slice(k, k + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[cut].view(np.int64)), pa.array(doc[cut]), pa.array(number[cut]), pa.array(span[cut]), payload.slice(k, 50_000)], names=["seed", "doc_id", "row", "span", "codes"]
            )


def _judge(table: pa.Table) -> pa.RecordBatch:
    """Repeated windows of whole seed groups, sorted by seed, document and place."""
    table = table.combine_chunks()
    seed, doc, span = (table.column(c).to_numpy() for c in ("seed", "doc_id", "span"))
    codes = table.column("codes")
    codes = codes.chunk(0) if codes.num_chunks else pa.array([], pa.binary())
    size = pc.binary_length(codes).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    n = (span & 31) + 1
    mask = np.where(size == 0, (1 << n) - 1, 0)
    live = np.flatnonzero(size > 0)
    if len(live):
        new = np.ones(len(live), bool)
        new[1:] = seed[live[1:]] != seed[live[:-1]]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        at = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1]
        values = np.frombuffer(codes.buffers()[2], np.uint64)[at[0] // 8 : at[-1] // 8]
        pick = np.repeat(np.isin(np.arange(len(size)), live[many]), size)
        rows, group = live[many], group[many]
        if len(rows):
            count = size[rows]
            row = np.repeat(rows, count)
            j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            place = ((span[row] >> 5) & 31) - j
            key, value = np.repeat(group, count) * 32 + place, values[pick]
            order = np.lexsort((value, key))
            same = np.zeros(len(order), bool)
            same[1:] = (key[order[1:]] == key[order[:-1]]) & (value[order[1:]] == value[order[:-1]])
            head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            again = (doc[row[order]] != doc[row[head]]) | ((span[row[order]] >> 10) + j[order] != (span[row[head]] >> 10) + j[head])
            mask += np.bincount(row[order][again], weights=2.0 ** j[order][again], minlength=len(mask)).astype(np.int64)
    hit = np.flatnonzero(mask)
    number, none = table.column("row").to_numpy()[hit], pa.nulls(len(hit), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(number), pa.array(((span[hit] >> 10) << 16) | mask[hit]), none, none, none], names=JUDGED)


def _pass_on(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The windows of rows of one crowded seed, each with its start and the cut that it is if it repeats."""
    for batch in table.combine_chunks().to_batches(max_chunksize=20_000):
        seed, doc, number, span = (batch.column(c).to_numpy() for c in ("seed", "doc_id", "row", "span"))
        codes = batch.column("codes")
        at = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1]
        values = np.frombuffer(codes.buffers()[2], np.int64)[at[0] // 8 : at[-1] // 8]
        n = np.diff(at) // 8
        row = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        first = span[row] >> 10
        key = mix(seed[row].view(np.uint64) + (((span[row] >> 5) & 31) - j).astype(np.uint64)).view(np.int64)
        cols = [doc[row], number[row], (first << 16) | (1 << j), first + j, key, values]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=JUDGED)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows, crowded = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < AHEAD:
            continue
        table = pa.Table.from_batches(held)
        seed = table.column("seed").to_numpy()
        if crowded is not None:
            stop = int(np.searchsorted(seed, crowded, "right"))
            yield from _pass_on(table.slice(0, stop))
            table, seed, crowded = table.slice(stop), seed[stop:], crowded if stop == len(seed) else None
        if len(seed):
            last = int(np.searchsorted(seed, seed[-1]))
            if last:
                yield _judge(table.slice(0, last))
                table = table.slice(last)
            elif crowded is None and len(seed) >= AHEAD:
                crowded = int(seed[0])
                yield from _pass_on(table)
                table = table.slice(0, 0)
        held, rows = table.combine_chunks().to_batches(), table.num_rows
    if held:
        table = pa.Table.from_batches(held)
        stop = int(np.searchsorted(table.column("seed").to_numpy(), crowded, "right")) if crowded is not None else 0
        yield from _pass_on(table.slice(0, stop))
        yield _judge(table.slice(stop))


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            total, gone, texts = [], [], []
            for text, cuts in zip(part.column("text").to_pylist(), part.column("cuts")):
                words = (text or "").encode().split()
                total.append(len(words))
                if cuts.is_valid and len(cuts):
                    cut = cuts.values.to_numpy()
                    begin = ((cut >> 16)[:, None] + np.arange(16))[(cut[:, None] >> np.arange(16)) & 1 == 1]
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, begin, 1)
                    np.add.at(depth, begin + WINDOW, -1)
                    stay = np.flatnonzero(np.cumsum(depth)[:-1] == 0)
                    gone.append(len(words) - len(stay))
                    words = [words[k] for k in stay]
                else:
                    gone.append(0)
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _rewrite(batches):
        digest = [hashlib.sha256(t.as_buffer()).hexdigest() for t in batch.column("kept")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def drop_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, and the kept words (or, asked for, their digest)."""
    docs = stable(docs)
    ids = F.col("doc_id").cast("long").alias("doc_id")
    # Cuts go back to their text by doc_id, and only where that repeats by the row's number too.
    alone = docs.select(ids).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    docs = docs.select(ids, (F.lit(0).cast("long") if alone else F.monotonically_increasing_id()).alias("row"), "text")
    seeds = docs.mapInArrow(_seed_rows, "seed long, doc_id long, row long, span long, codes binary")
    met = seeds.repartition("seed").sortWithinPartitions("seed", "doc_id", "span")
    judged = written(met.mapInArrow(_repeats, ", ".join(f"{c} long" for c in JUDGED)))
    cuts, crowds = judged.where("key is null").select(*JUDGED[:3]), judged.where("key is not null")
    if not crowds.isEmpty():
        crowds = with_totals(crowds, ["key", "code"], "doc_id", [F.min(F.struct("doc_id", "start")).alias("earliest")])
        cuts = cuts.union(crowds.where("doc_id <> earliest.doc_id or start <> earliest.start").select(*JUDGED[:3]))
    cuts = cuts.groupBy("doc_id", "row").agg(F.collect_list("cut").alias("cuts"))
    both = docs.join(cuts, ["doc_id", "row"], "left")
    if digest:
        return both.mapInArrow(_digested, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return both.mapInArrow(_rewrite, "doc_id long, n_words long, n_removed long, kept string")
