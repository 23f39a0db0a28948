"""Queries that SQL cannot express: bit-serial codes, framing and whole coding round trips."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import framing, prefix
from ..functions.payload import NO_CHUNK, Chunk, read_plain, write_plain
from ..operators import metrics, runs
from ..operators.base import UniformBase
from ..session import settle, table
from ..sources.adapters import embedding_rows, event_frames, event_planes, text_bytes, user_values
from . import closed_loop, codec
from .config import CHROMA, SCALING, TILES, UPSAMPLER, StreamConfig, read_global
from .queries import _Q_STEP, _RUNS, CODED, EV, query

CODEC = StreamConfig(8, 8, chroma="mono", block=2, scaling_low="0d", scaling_top="2d", average=False)
STEPS = (300, 500)


@query()
def canonical_codes(spark: SparkSession, d: str) -> DataFrame:
    """Prefix code of each document's bytes: (doc_id, byte, n, length, code, bits)."""
    counts = text_bytes(spark, d).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("byte", "n")))).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, counted in zip(batch.column("doc_id").to_pylist(), batch.column("counts").to_pylist()):
                counted = dict(counted)
                for byte, (code, length) in prefix.canonical(prefix.code_lengths(counted)).items():
                    rows.append((doc, byte, counted[byte], length, code, counted[byte] * length))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6, names=["doc_id", "byte", "n", "length", "code", "bits"])

    return counts.mapInArrow(run, "doc_id long, byte long, n long, length long, code long, bits long")


def _each(df: DataFrame, key: str, value: str, work, names: list[str]) -> DataFrame:
    """Rows (key, *names) of longs that ``work`` makes of each row's ``value``."""
    return _rows(df, key, value, lambda v: [work(v)], names)


def _rows(df: DataFrame, key: str, value: str, work, names: list[str]) -> DataFrame:
    """The same, of any number of rows for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [work(v) for v in batch.column(value).to_pylist()]
            keys = batch.column(key).take(pa.array([i for i, m in enumerate(made) for _ in m], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array([int(o[k]) for m in made for o in m], pa.int64()) for k in range(len(names))]], names=[key, *names])

    return df.select(key, value).mapInArrow(run, f"{key} long, " + ", ".join(f"{n} long" for n in names))


@query(f"WITH {_RUNS} SELECT user_id, event, value, zero_run FROM evs")
def chunk_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user as their coefficient chunk gives them back; raw chunks must say the same."""
    events = runs.coefficient_runs(user_values(spark, d), ["user_id"], "i", "v")
    packed = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event", "value", "zero_run"))).alias("events"))

    def work(rows):
        given, total = [(r["value"], r["zero_run"]) for r in rows], sum(r["zero_run"] + 1 for r in rows)
        back = prefix.read_coefficients(prefix.coefficient_chunk(given), total)
        if prefix.read_coefficients(prefix.coefficient_chunk(given, raw=True), total, raw=True) != back:
            raise ValueError("raw and coded chunks differ")
        return [(r["event"], *e) for r, e in zip(rows, back, strict=True)]

    return _rows(packed, "user_id", "events", work, ["event", "value", "zero_run"])


@query(f"""WITH {_RUNS}, b AS (SELECT user_id, 1 + (value < -32 OR value >= 32)::BIGINT + (zero_run > 0)::BIGINT + (zero_run >= 128)::BIGINT + (zero_run >= 16384)::BIGINT AS n FROM evs)
SELECT user_id, sum(n)::BIGINT AS raw_bytes, true AS shorter FROM b GROUP BY 1""")
def chunk_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of each user's uncoded chunk; a coded one is at most that and its three tables."""
    events = runs.coefficient_runs(user_values(spark, d), ["user_id"], "i", "v")
    packed = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event", "value", "zero_run"))).alias("events"))

    def work(rows):
        given = [(r["value"], r["zero_run"]) for r in rows]
        raw, coded = (len(prefix.coefficient_chunk(given, raw=x)) for x in (True, False))
        return raw, coded <= raw + 3 * (3 + 256 * 2)

    return _each(packed, "user_id", "events", work, ["raw_bytes", "shorter"]).withColumn("shorter", F.col("shorter") == 1)


@query("""WITH s AS (SELECT l_orderkey, l_partkey % 8192 AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS i FROM lineitem)
SELECT l_orderkey, i, size, size - coalesce(lag(size) OVER (PARTITION BY l_orderkey ORDER BY i), 0) AS delta FROM s""")
def sizes_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the items of each order and their differences, read back from size chunks."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("sizes"))

    def work(sizes):
        sizes = [s % 8192 for s in sizes]
        deltas = [b - a for a, b in zip([0, *sizes], sizes)]
        plain, signed = prefix.size_chunk(sizes), prefix.size_chunk(deltas, signed=True)
        return list(zip(range(len(sizes)), prefix.read_sizes(plain, len(sizes))[0], prefix.read_sizes(signed, len(sizes), signed=True)[0], strict=True))

    return _rows(rows, "l_orderkey", "sizes", work, ["i", "size", "delta"])


@query("""WITH e AS (SELECT user_id, event_id, (value > 50)::BIGINT AS signal FROM events), t AS (SELECT *, coalesce((signal <> lag(signal) OVER w)::BIGINT, 0) AS turn FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM t) SELECT user_id, run, signal, count(*) AS count FROM r GROUP BY 1, 2, 3""")
def signals_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each user's signals, read back from temporal chunks."""
    events = table(spark, d, "events").select("user_id", F.col("event_id").alias("i"), (F.col("value") > 50).cast("bigint").alias("signal"))
    found = runs.signal_runs(events, ["user_id"], "i", "signal").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("run", "signal", "count"))).alias("runs"))

    def work(rows):
        given = [(r["signal"], r["count"]) for r in rows]
        return [(k, *r) for k, r in enumerate(prefix.read_signals(prefix.signal_chunk(given), sum(n for _, n in given)))]

    return _rows(found, "user_id", "runs", work, ["run", "signal", "count"])


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, 1::BIGINT AS same, 1::BIGINT AS one_start FROM documents WHERE text IS NOT NULL")
def nal_escape_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Units around payloads full of zeros: whether they read back, without a false start code."""
    rows = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    low = bytes.maketrans(b"aeioun ", b"\0\0\0\1\2\3\0")

    def work(data):
        data = data.translate(low)
        blocks = [(framing.PICTURE, data[:4]), (framing.DATA, data)]
        made = framing.unit(len(data) % 2 == 0, blocks)
        return len(data), framing.read_unit(made) == (len(data) % 2 == 0, blocks), len(framing.split_units(made)) == 1

    return _each(rows.where("data is not null"), "doc_id", "data", work, ["bytes", "same", "one_start"])


@query("""SELECT k AS id, CASE WHEN f = 1 THEN 1920 ELSE 64 * (1 + k % 9) END AS width, CASE WHEN f = 1 THEN 1080 ELSE 32 END AS height, CASE (k // 120) % 2 WHEN 0 THEN 2 ELSE 4 END AS block, (k // 6) % 4 AS chroma, (k // 24) % 5 AS upsampler,
 2 - (k // 720) AS scaling_low, 2 - (k // 240) % 3 AS scaling_top, CASE k % 3 WHEN 2 THEN 3 ELSE k % 3 END AS tiles, CASE WHEN f = 1 THEN 10 ELSE 8 END AS depth, 1 - f AS temporal, CASE WHEN f = 1 THEN 48 ELSE 20 END AS modifier, CASE WHEN f = 1 THEN 64 ELSE 40 END AS multiplier, 1::BIGINT AS same
 FROM (SELECT k, (k // 3) % 2 AS f FROM range(2160) t(k))""")
def config_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every combination of stream options as read back from its bits."""
    options = list(product(("2d", "1d", "0d"), ("2d", "1d", "0d"), (2, 4), ("nearest", "linear", "cubic", "modified_cubic", "adaptive"), ("mono", "420", "422", "444"), (False, True), ("none", "512x256", "custom")))
    rows = spark.range(len(options)).withColumn("k", F.col("id"))

    def work(k):
        low, top, block, up, chroma, flag, tiles = options[k]
        cfg = StreamConfig(1920 if flag else 64 * (1 + k % 9), 1080 if flag else 32, 8, 10 if flag else 8, chroma, block, up, (-5, 14000, 2500, -7) if up == "adaptive" else (0, 16384, 0, 0), low, top, tiles, (64, 32) if tiles == "custom" else (0, 0), flag and tiles != "none", k % 3 if tiles != "none" else 0, flag, not flag, 48 if flag else 20, 64 if flag else 40, (3, 9) if flag else None)
        back = read_global(cfg.global_bits(), cfg.sequence_bits())
        codes = CHROMA[back.chroma], UPSAMPLER[back.upsampler], SCALING[back.scaling_low], SCALING[back.scaling_top], TILES[back.tiles]
        return back.width, back.height, back.block, *codes, back.depth, back.temporal, back.modifier, back.multiplier, back == cfg

    return _each(rows, "id", "k", work, ["width", "height", "block", "chroma", "upsampler", "scaling_low", "scaling_top", "tiles", "depth", "temporal", "modifier", "multiplier", "same"])


@query()
def encode_decode_exact(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: embeddings as frames, coded in two levels, chunked, decoded and compared.

    (frame_idx, sse, n, psnr, max_diff, chunk_bytes): distortion against the
    source, the decoder's largest difference from the encoder (0), coded size.
    """
    source = embedding_rows(spark, d)
    coded = codec.encode(source, CODEC, *STEPS, settle=settle)
    stream = settle(codec.chunks(coded, CODEC))
    decoded = codec.decode(coded.base, stream, CODEC, *STEPS, rows=True)
    quality = metrics.row_error(source, coded.rows, ["frame_idx"]).select("frame_idx", "sse", "n")
    same = metrics.row_error(coded.rows, decoded, ["frame_idx"]).select("frame_idx", "max_diff")
    size = stream.groupBy("frame_idx").agg(F.sum(F.length("data")).cast("bigint").alias("chunk_bytes"))
    return quality.join(same, "frame_idx").join(size, "frame_idx", "left").select("frame_idx", "sse", "n", F.round(metrics.psnr(255), 6).alias("psnr"), "max_diff", F.coalesce("chunk_bytes", F.lit(0).cast("bigint")).alias("chunk_bytes"))


@query(f"WITH {CODED} SELECT frame_idx, sum((s - v) * (s - v))::BIGINT AS sse, count(*) AS n, 0::BIGINT AS max_diff FROM dec GROUP BY 1")
def coded_distortion(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings coded in 4x4 blocks, chunked and decoded: the decoder's error against the source, and against the coder."""
    cfg = StreamConfig(8, 8, chroma="mono", block=4, scaling_low="0d", average=False)
    source = embedding_rows(spark, d)
    coded = codec.encode(source, cfg, _Q_STEP, _Q_STEP, settle=settle)
    decoded = settle(codec.decode(coded.base, settle(codec.chunks(coded, cfg)), cfg, _Q_STEP, _Q_STEP, rows=True))
    quality = metrics.row_error(source, decoded, ["frame_idx"]).select("frame_idx", "sse", "n")
    return quality.join(metrics.row_error(coded.rows, decoded, ["frame_idx"]).select("frame_idx", "max_diff"), "frame_idx")


@query("""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(DISTINCT b) AS symbols, count(*)::BIGINT AS bytes, 1.0::DOUBLE AS kraft, true AS ordered FROM h GROUP BY 1""")
def code_sums(spark: SparkSession, d: str) -> DataFrame:
    """Of each document's prefix code: symbols, bytes, the Kraft sum (1), and whether rarer bytes never have shorter codes."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("n")
    codes = canonical_codes(spark, d).withColumn("floor", F.min("length").over(w.rangeBetween(Window.unboundedPreceding, -1)))
    return codes.groupBy("doc_id").agg(F.count("*").alias("symbols"), F.sum("n").alias("bytes"), F.sum(F.pow(F.lit(2.0), -F.col("length"))).alias("kraft"), F.min(F.col("length") <= F.coalesce("floor", F.col("length"))).alias("ordered"))


@query()
def encode_decode_4x4(spark: SparkSession, d: str) -> DataFrame:
    """16x16 event frames with 4x4 blocks and both levels scaled."""
    cfg = StreamConfig(16, 16, base_depth=10, depth=10, chroma="mono", block=4, upsampler="cubic", average=True)
    source = event_frames(spark, d)
    coded = codec.encode(source, cfg, 600, 400, settle=settle)
    decoded = codec.decode(coded.base, settle(codec.chunks(coded, cfg)), cfg, 600, 400)
    same = metrics.squared_error(metrics.paired(coded.output, decoded), ["frame_idx"]).select("frame_idx", "max_diff")
    quality = metrics.squared_error(metrics.paired(source, coded.output), ["frame_idx"]).select("frame_idx", "sse")
    return quality.join(same, "frame_idx")


def _streams(spark: SparkSession, d: str) -> DataFrame:
    """Event frames dealt out to four streams, a picture a row; a stream's pictures count from 0."""
    rows = event_frames(spark, d).groupBy("frame_idx").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("s"))
    return rows.select((F.col("frame_idx") % 4).alias("stream"), F.call_function("div", F.col("frame_idx"), F.lit(4)).alias("frame_idx"), F.transform("s", lambda s: s["v"].cast("int")).alias("data"))


def _colour_streams(spark: SparkSession, d: str) -> DataFrame:
    """The same as 4:2:0 pictures of three planes."""
    rows = event_planes(spark, d).groupBy("frame_idx").agg(F.array_sort(F.collect_list(F.struct("plane", "y", "x", "v"))).alias("s"))
    return rows.select((F.col("frame_idx") % 4).alias("stream"), F.call_function("div", F.col("frame_idx"), F.lit(4)).alias("frame_idx"), F.transform("s", lambda s: s["v"].cast("int")).alias("data"))


@query()
def closed_loop_rate(spark: SparkSession, d: str) -> DataFrame:
    """Rate control, adaptive matrices and frame drop along each stream."""
    cfg = StreamConfig(16, 16, base_depth=10, depth=10, chroma="mono", block=4)
    return closed_loop.code_streams(_streams(spark, d), "stream", cfg, closed_loop.Control(target_bytes=160))


@query()
def closed_loop_temporal(spark: SparkSession, d: str) -> DataFrame:
    """Temporal prediction with refresh frames along each stream, over a lossy base."""
    cfg = StreamConfig(16, 16, base_depth=10, depth=10, chroma="mono", block=2, temporal=True)
    return closed_loop.code_streams(_streams(spark, d), "stream", cfg, closed_loop.Control(refresh_every=8), UniformBase(8))


@query(f"WITH {EV} SELECT frame_idx % 4 AS stream, frame_idx // 4 AS frame_idx, 0::BIGINT AS max_diff, (count(*) * 3 // 2)::BIGINT AS samples FROM ev GROUP BY 1, 2")
def closed_loop_decoded(spark: SparkSession, d: str) -> DataFrame:
    """4:2:0 streams with temporal prediction, rate control and drops, read back from their units: no sample differs from the coder's picture."""
    cfg = StreamConfig(16, 16, base_depth=10, depth=10, block=2, scaling_low="0d", temporal=True, multiplier=40)
    control = closed_loop.Control(refresh_every=8, target_bytes=300)
    coded = settle(closed_loop.code_streams(_colour_streams(spark, d), "stream", cfg, control, UniformBase(8), stream=True))
    both = closed_loop.decode_streams(coded, "stream", cfg).join(coded.select("stream", "frame_idx", "output"), ["stream", "frame_idx"])
    apart = F.array_max(F.zip_with("data", "output", lambda a, b: F.abs(a - b)))
    return both.select("stream", "frame_idx", apart.cast("bigint").alias("max_diff"), F.size("data").cast("bigint").alias("samples"))


@query(f"WITH {EV} SELECT frame_idx, p::BIGINT AS plane, 0::BIGINT AS max_diff, (count(*) // CASE WHEN p = 0 THEN 1 ELSE 4 END)::BIGINT AS samples FROM ev, range(3) t(p) GROUP BY frame_idx, p")
def encode_decode_420(spark: SparkSession, d: str) -> DataFrame:
    """All planes of 4:2:0 pictures coded in one plan with their own steps, and decoded: no sample differs."""
    cfg = StreamConfig(16, 16, base_depth=10, depth=10, block=4, scaling_low="0d", multiplier=40, upsampler="cubic", filter_levels=(2, 1))
    coded = codec.encode(event_planes(spark, d), cfg, 600, 400, settle=settle, lambda_div=4)
    decoded = codec.decode(coded.base, settle(codec.chunks(coded, cfg)), cfg, 600, 400, rows=True)
    same = metrics.row_error(coded.rows, decoded, ["frame_idx", "plane"])
    return same.select("frame_idx", "plane", "max_diff", F.col("n").alias("samples"))


@query(f"WITH {EV}, b AS (SELECT frame_idx, plane, y, x, CASE WHEN (frame_idx + y + x) % 97 = 0 THEN v + 1 ELSE v END AS w FROM ev) SELECT ev.frame_idx, max(abs(v - w)) AS max_diff, count(*) AS samples FROM ev JOIN b ON ev.frame_idx = b.frame_idx AND ev.y = b.y AND ev.x = b.x GROUP BY 1")
def verify_streams(spark: SparkSession, d: str) -> DataFrame:
    """Two streams zipped by frame and place: the largest difference of each frame."""
    a = event_frames(spark, d)
    changed = F.when((F.col("frame_idx") + F.col("y") + F.col("x")) % 97 == 0, F.col("v") + 1).otherwise(F.col("v"))
    return metrics.squared_error(metrics.paired(a, a.withColumn("v", changed)), ["frame_idx"]).select("frame_idx", "max_diff", F.col("n").alias("samples"))


@query()
def payload_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of coded frames: flags and chunks framed as units, read back, chunks compared."""
    source = embedding_rows(spark, d)
    stream = codec.chunks(codec.encode(source, CODEC, *STEPS, settle=settle), CODEC)
    packed = stream.groupBy("frame_idx").agg(F.collect_list(F.struct("plane", "level", "layer", "data")).alias("chunks"))

    def work(rows):
        chunks = {(r["plane"], r["level"], r["layer"]): [Chunk(r["data"])] for r in rows}
        data = write_plain(chunks, 1, 4, False)
        unit = framing.unit(True, [(framing.SEQUENCE, CODEC.sequence_bits()), (framing.GLOBAL, CODEC.global_bits()), (framing.DATA, data)])
        blocks = dict(framing.read_unit(unit)[1])
        back = {k: v for k, v in read_plain(blocks[framing.DATA], 1, 4, False).items() if v != [NO_CHUNK]}
        return len(chunks), len(unit), back == chunks and read_global(blocks[framing.GLOBAL], blocks[framing.SEQUENCE]) == CODEC

    return _each(packed, "frame_idx", "chunks", work, ["chunks", "unit_bytes", "same"])
