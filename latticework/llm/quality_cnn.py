"""Document quality by a byte-level convolutional network in numpy.

Every second byte of the whole document starts a six-byte window, to which the
learned filters of the first layer respond (a row of weights for each byte value
and place).  A chunk is 256 bytes and overlaps the next by half; of each
filter it holds the mean and the largest rectified response.  The second layer
is learned filters over these, so that it can tell prose, whose windows differ,
from text that says the same again.  Each of its filters keeps its largest chunk
of the document, and a small dense layer combines these into one probability.

The network is fitted on a bounded sample (``SAMPLE`` documents a class, each of
at most ``LONGEST`` characters) of labelled rows outside the held-out fold, and
its offset is set to the labelled rows' class shares.  Nothing but the bytes of
the text is an input of a score.

Defined cases: null text is empty; an empty text has a score (that of no
chunks); repeated rows score alike; a doc_id with several labels counts with the
smallest; without labelled rows of both classes the score is 0.5; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bucket, per_class
from .textscan import slices, text_bytes

SAMPLE = 400
LONGEST = 100_000
WIDTH, STRIDE, FILTERS, SECOND, HIDDEN = 6, 2, 24, 24, 8
HALF = 64
KEEP = 0.3
STEP = 2048


class Chunks:
    """Windows, half chunks and chunks of several texts."""

    def __init__(self, column: pa.Array):
        raw, ends = text_bytes(column)
        self.n = len(ends) - 1
        length = np.diff(ends)
        at = ends + np.arange(self.n + 1) * WIDTH  # zeros behind each text, so no window sees the next one
        self.data = np.zeros(len(raw) + (self.n + 1) * WIDTH, np.uint8)
        self.data[np.arange(len(raw)) + np.repeat(np.arange(self.n) * WIDTH, length)] = raw
        count = (length + STRIDE - 1) // STRIDE
        before = np.cumsum(count) - count
        self.start = np.repeat(at[:-1] - before * STRIDE, count) + np.arange(int(count.sum())) * STRIDE
        halves = (count + HALF - 1) // HALF
        ahead = np.cumsum(halves) - halves
        self.half = np.repeat(before - ahead * HALF, halves) + np.arange(int(halves.sum())) * HALF
        self.size = np.diff(np.append(self.half, len(self.start)))
        # A chunk is two halves that follow each other; a text of one half is one chunk.
        chunks = np.maximum(halves - 1, np.minimum(halves, 1))
        upto = np.cumsum(chunks) - chunks
        self.head = np.repeat(ahead - upto, chunks) + np.arange(int(chunks.sum()))
        self.tail = self.head + np.repeat(halves > 1, chunks)
        self.doc = np.repeat(np.arange(self.n), chunks)
        self.has, self.first = np.flatnonzero(halves), upto[halves > 0]
        self.windows = self.size[self.head] + np.where(self.tail > self.head, self.size[self.tail], 0)

    def halves(self, response: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and maxima of the half chunks."""
        return np.add.reduceat(response, self.half, axis=0), np.maximum.reduceat(response, self.half, axis=0)

    def pooled(self, total: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Means and maxima of each chunk side by side."""
        both = total[self.head] + np.where((self.tail > self.head)[:, None], total[self.tail], 0)
        means = both / self.windows[:, None].astype(total.dtype)
        return np.concatenate([means, np.maximum(most[self.head], most[self.tail])], 1)


class Network:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        single = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.filters, self.bias = single(WIDTH, 256, FILTERS, scale=0.25), np.zeros(FILTERS, np.float32)
        self.second, self.second_bias = single(2 * FILTERS, SECOND, scale=(2 * FILTERS) ** -0.5), np.zeros(SECOND, np.float32)
        self.dense, self.dense_bias = single(SECOND, HIDDEN, scale=0.5), np.zeros(HIDDEN, np.float32)
        self.top, self.top_bias = single(HIDDEN, scale=0.5), np.zeros(1, np.float32)
        self.shift, self.scale = np.zeros(2 * FILTERS, np.float32), np.ones(2 * FILTERS, np.float32)
        self.offset = 0.0
        self.pairs: np.ndarray | None = None

    def params(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.second, self.second_bias, self.dense, self.dense_bias, self.top, self.top_bias]

    def halves(self, chunks: Chunks) -> tuple[np.ndarray, np.ndarray]:
        """Sums and maxima of the half chunks; responses are made for ``STEP`` halves at a time, however long a text is."""
        if self.pairs is None:
            f = self.filters
            self.pairs = (f[0::2, :, None, :] + f[1::2, None, :, :]).reshape(WIDTH // 2, 65536, FILTERS)
        wide = chunks.data[:-1].astype(np.int32) << 8 | chunks.data[1:]
        total, most = (np.empty((len(chunks.half), FILTERS), np.float32) for _ in range(2))
        edge = np.append(chunks.half, len(chunks.start))
        for i in range(0, len(chunks.half), STEP):
            cut = slice(i, min(i + STEP, len(chunks.half)))
            start = chunks.start[edge[cut.start] : edge[cut.stop]]
            out = self.pairs[0][wide[start]]
            for k in range(1, WIDTH // 2):
                out += self.pairs[k][wide[start + 2 * k]]
            out += self.bias
            np.maximum(out, 0, out=out)
            at = edge[cut] - edge[cut.start]
            total[cut], most[cut] = np.add.reduceat(out, at, axis=0), np.maximum.reduceat(out, at, axis=0)
        return total, most

    def respond(self, chunks: Chunks) -> np.ndarray:
        """Rectified responses of the first layer to each window."""
        out = np.zeros((len(chunks.start), FILTERS), np.float32)
        for k in range(WIDTH):
            out += self.filters[k][chunks.data[chunks.start + k]]
        return np.maximum(out + self.bias, 0)

    def forward(self, chunks: Chunks, response: np.ndarray | None = None):
        feature, pooled, second, most = np.zeros((chunks.n, SECOND), np.float32), None, None, None
        if len(chunks.head):
            total, most = self.halves(chunks) if response is None else chunks.halves(response)
            pooled = (chunks.pooled(total, most) - self.shift) / self.scale
            second = np.maximum(pooled @ self.second + self.second_bias, 0)
            feature[chunks.has] = np.maximum.reduceat(second, chunks.first, axis=0)
        hidden = np.tanh(feature @ self.dense + self.dense_bias)
        return feature, hidden, hidden @ self.top + self.top_bias[0], pooled, second, most

    def score(self, column: pa.Array) -> np.ndarray:
        z = self.forward(Chunks(column))[2].astype(np.float64) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def _gradients(self, chunks: Chunks, response: np.ndarray, quality: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        feature, hidden, z, pooled, second, most = self.forward(chunks, response)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        dz = ((p - quality) * weight / len(quality)).astype(np.float32)
        dhidden = dz[:, None] * self.top * (1 - hidden**2)
        tops = [feature.T @ dhidden, dhidden.sum(0), hidden.T @ dz, dz.sum(keepdims=True)]
        if pooled is None:
            return [np.zeros_like(x) for x in self.params()[:4]] + tops
        best = (feature[chunks.doc] == second) & (second > 0)
        dsecond = np.where(best, (dhidden @ self.dense.T)[chunks.doc], 0)
        dpooled = (dsecond @ self.second.T) / self.scale
        dmean, dmost = dpooled[:, :FILTERS] / chunks.windows[:, None], dpooled[:, FILTERS:]
        left = most[chunks.head] >= most[chunks.tail]
        two = chunks.tail > chunks.head
        by_half, at_most = np.zeros_like(most), np.zeros_like(most)
        np.add.at(by_half, chunks.head, dmean)
        np.add.at(by_half, chunks.tail[two], dmean[two])
        np.add.at(at_most, chunks.head, np.where(left, dmost, 0))
        np.add.at(at_most, chunks.tail, np.where(left, 0, dmost))
        half = np.repeat(np.arange(len(chunks.half)), chunks.size)
        peak = response == most[half]
        at_most /= np.add.reduceat(peak.astype(np.float32), chunks.half, axis=0)
        back = (by_half[half] + np.where(peak, at_most[half], 0)) * (response > 0)
        live = np.flatnonzero(np.abs(back).sum(1))
        back, start = back[live], chunks.start[live]
        dfilters = np.zeros_like(self.filters)
        for k in range(WIDTH):
            byte = chunks.data[start + k]
            for f in range(FILTERS):
                dfilters[k, :, f] = np.bincount(byte, back[:, f], 256)
        return [dfilters + 1e-4 * self.filters, back.sum(0), pooled.T @ dsecond + 1e-4 * self.second, dsecond.sum(0), *tops]

    def fit(self, texts: list[str], quality: np.ndarray, epochs: int = 9, batch: int = 40, rate: float = 0.02) -> None:
        rng, step = np.random.default_rng(2), 0
        params = self.params()
        first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
        weight = np.where(quality == 1, 0.5 / max(1, (quality == 1).sum()), 0.5 / max(1, (quality == 0).sum())) * len(quality)
        groups = rng.permutation(len(texts))
        made = [(g, Chunks(pa.array([texts[i] for i in g], pa.string()))) for g in np.array_split(groups, max(1, len(texts) // batch))]
        seen = [c.pooled(*c.halves(self.respond(c))) for _, c in made[:10] if len(c.head)]
        if seen:
            self.shift, self.scale = np.concatenate(seen).mean(0), np.concatenate(seen).std(0) + np.float32(1e-3)
        for epoch in range(epochs):
            for b in rng.permutation(len(made)):
                rows, chunks = made[b]
                grads = self._gradients(chunks, self.respond(chunks), quality[rows], weight[rows])
                step += 1
                for j, (x, g) in enumerate(zip(params, grads)):
                    first[j] = 0.9 * first[j] + 0.1 * g
                    second[j] = 0.98 * second[j] + 0.02 * g * g
                    x -= (rate / (1 + epoch / 4)) * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.98**step)) + 1e-7)
        self.pairs = None


def held_out():
    return bucket(5) == 0


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    """A network fitted on at most about ``SAMPLE`` labelled documents a class, outside the held-out fold."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = per_class(known, "quality", SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= LONGEST)
    rows = sorted(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").distinct().collect())
    net = Network()
    quality = np.array([r.quality for r in rows])
    if len(set(quality.tolist())) == 2:
        net.fit([r.text for r in rows], quality)
        net.offset = float(np.log(share[1] / share[0]))
    else:
        net.top[:] = 0
    return net


def score_quality(docs: DataFrame, net: Network) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = shared.value.score(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= KEEP).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return given.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs``, all columns, that the network does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(shared.value.score(part.column("text")) >= KEEP))

    return docs.mapInArrow(run, docs.schema)
