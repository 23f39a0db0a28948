"""Known vectors of the frame operators, and video files."""

import pytest
from pyspark.sql import functions as F

from latticework.functions import fixedpoint as fp
from latticework.operators import blocks, control, metrics, runs, stencil
from latticework.plans import codec
from latticework.plans.config import StreamConfig
from latticework.session import share_code
from latticework.sources import annexb, video


def frame(spark, rows, idx=0):
    return spark.createDataFrame([(idx, 0, y, x, v) for y, r in enumerate(rows) for x, v in enumerate(r)], "frame_idx long, plane long, y long, x long, v long")


def grid(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.y, {})[r.x] = r.v
    return [[row[x] for x in sorted(row)] for _, row in sorted(out.items())]


def test_known_rows(spark):
    share_code(spark)
    line = frame(spark, [[0, 64, 128, 192]]).withColumn("v", fp.to_internal("v", 8))
    assert grid(stencil.upscale(line, "1d", stencil.KERNELS["linear"])) == [[-16384, -14336, -10240, -6144, -2048, 2048, 6144, 8192]]
    assert grid(stencil.upscale(frame(spark, [[10, 20, 30, 40]]), "1d", stencil.KERNELS["nearest"])) == [[10, 10, 20, 20, 30, 30, 40, 40]]


def test_box(spark):
    rows = [[100, 100, 200, 200]] * 2 + [[200, 200, 100, 100]] * 2
    assert grid(stencil.downscale(frame(spark, rows), "2d", 8)) == [[100, 200], [200, 100]]
    assert grid(stencil.downscale(frame(spark, rows), "0d", 8)) == rows


def test_gradient_stays_smooth(spark):
    wide = stencil.upscale(frame(spark, [[80 + x // 32 for x in range(640)]]).withColumn("v", fp.to_internal("v", 8)), "1d", stencil.KERNELS["cubic"])
    out = wide.withColumn("v", fp.to_sample("v", 8))
    assert out.where("v < 79 or v > 101").count() == 0


def test_average_keeps_the_mean(spark):
    src = frame(spark, [[3 * x * y % 50 for x in range(6)] for y in range(6)])
    up = stencil.upscale(src, "2d", stencil.KERNELS["modified_cubic"], True)
    mean = up.groupBy(fp.shr("y", 1).alias("y"), fp.shr("x", 1).alias("x")).agg(F.sum("v").alias("s")).join(src, ["y", "x"])
    assert mean.where("abs(s - 4 * v) > 2").count() == 0


def test_pad_and_crop(spark):
    src = frame(spark, [[1, 2, 3], [4, 5, 6]])
    big = stencil.pad(src, 3, 2, 4)
    assert grid(big) == [[1, 2, 3, 512], [4, 5, 6, 512], [512] * 4, [512] * 4] and grid(stencil.crop(big, 3, 2)) == [[1, 2, 3], [4, 5, 6]]


@pytest.mark.parametrize("size", [2, 4])
def test_blocks_scatter_back(spark, size):
    src = frame(spark, [[y * 100 + x for x in range(8)] for y in range(8)])
    assert grid(blocks.scatter(blocks.gather(src, size), size)) == grid(src)


def test_runs_with_leading_zeros(spark):
    seqs = {1: [0, 0, 5, 0, -2, 0, 0], 2: [0, 0], 3: [7], 4: [0, 1]}
    df = spark.createDataFrame([(k, i, v) for k, s in seqs.items() for i, v in enumerate(s)], "k long, i long, v long")
    got = {}
    for r in sorted(runs.coefficient_runs(df, ["k"], "i", "v").collect(), key=lambda r: (r.k, r.event)):
        got.setdefault(r.k, []).append((r.value, r.zero_run))
    assert got == {1: [(0, 1), (5, 1), (-2, 2)], 2: [(0, 1)], 3: [(7, 0)], 4: [(0, 0), (1, 0)]}
    back = {(r.k, r.position, r.value) for r in runs.expand_runs(runs.coefficient_runs(df, ["k"], "i", "v"), ["k"]).collect()}
    assert back == {(k, i, v) for k, s in seqs.items() for i, v in enumerate(s) if v}


def test_equal_pictures_have_no_error(spark):
    src = frame(spark, [[1, 2], [3, 4]])
    row = metrics.frame_psnr(src.withColumn("w", F.col("v")), 8).where("frame_idx is not null and plane is not null").first()
    assert row.sse == 0 and row.psnr == float("inf")


def test_buffer_marks_clamped_sums(spark):
    df = spark.createDataFrame([(0, i, v, i == 0) for i, v in enumerate([30000, 5000, -9000])], "p long, f long, v long, intra boolean")
    out = [(r.buffer, r.clamped) for r in control.temporal_buffer(df, ["p"], "f", "intra", "v").orderBy("f").collect()]
    assert out == [(30000, False), (32767, True), (23767, False)]  # clamped at each frame, so what it lost stays lost


@pytest.mark.parametrize("block,low,top,average", [(2, "0d", "2d", True), (4, "2d", "2d", True), (4, "1d", "1d", False), (2, "1d", "2d", False)])
def test_decoder_equals_encoder(spark, block, low, top, average):
    cfg = StreamConfig(32, 16, chroma="mono", block=block, upsampler="modified_cubic", scaling_low=low, scaling_top=top, average=average)
    src = frame(spark, [[(x * x + 7 * y * x) % 200 for x in range(32)] for y in range(16)])
    coded = codec.encode(src, cfg, 400, 200)
    stream = codec.chunks(coded, cfg).cache()
    out = codec.decode(coded.base, stream, cfg, 400, 200)
    assert stream.count() and grid(out) == grid(coded.output)


def test_video_files(spark, tmp_path):
    share_code(spark)
    rows = [(k, p, w, h, 10, [(k * 37 + p * 11 + i * 3) % 1024 for i in range(w * h)]) for k in range(5) for p, (w, h) in enumerate([(6, 4), (3, 2), (3, 2)])]
    planes = spark.createDataFrame(rows, video.PLANES)
    lay = video.Layout(6, 4, 10, fps=(30, 1))
    assert video.write_y4m(planes, str(tmp_path / "a.y4m"), lay) == 5 and video.write_yuv(planes, str(tmp_path / "a.yuv")) == 5
    key = lambda r: (r.frame_idx, r.plane)
    read = video.read_video(spark, str(tmp_path / "a.y4m"), framesPerTask=2)
    assert [tuple(r) for r in sorted(read.collect(), key=key)] == rows
    raw = video.read_video(spark, str(tmp_path / "a.yuv"), width=6, height=4, depth=10, outDepth=8, frames=3)
    assert [tuple(r) for r in sorted(raw.collect(), key=key)] == [(*r[:4], 8, [v >> 2 for v in r[5]]) for r in rows[:9]]
    again = video.to_planes(video.to_samples(read), 10)
    assert [tuple(r) for r in sorted(again.select(read.columns).collect(), key=key)] == rows
    (tmp_path / "cut.y4m").write_bytes((tmp_path / "a.y4m").read_bytes()[:-1])
    with pytest.raises(Exception, match="truncated"):
        video.read_video(spark, str(tmp_path / "cut.y4m")).count()
    assert video.parse_y4m(b"YUV4MPEG2 W2 H2 F25:0\n").fps == (25, 1)
    for bad in (b"nothing\n", b"YUV4MPEG2 W2 H2\n", b"YUV4MPEG2 W2 H2 F1:1 C444\n"):
        with pytest.raises(ValueError):
            video.parse_y4m(bad)


def test_units_of_streams(spark):
    share_code(spark)
    one = b"\0\0\0\1\0\x79ab" + b"\0\0\1\0\x01pic" + b"\0\0\1\0\x09pic2" + b"\0\0\1\0\x61tail"
    df = spark.createDataFrame([(1, bytearray(one)), (2, None)], "stream_id long, data binary")
    parts = annexb.units(df).cache()
    assert parts.count() == 4
    aus = sorted((r.au, r.start, r.length) for r in annexb.access_units(parts).collect())
    assert len(aus) == 2 and aus[0][1] == 0 and sum(a[2] for a in aus) == len(one)


def planes_of(spark, count=6, side=32, streams=("a", "b")):
    rows = []
    for s, name in enumerate(streams):
        for k in range(count):
            data = [int((x * x + 7 * y * x + 9 * k * (1 + s)) % 200) if (x // 8 + y // 8 + s) % 2 else 60 + x + k for y in range(side) for x in range(side)]
            rows.append((name, k, side, side, data))
    return rows, spark.createDataFrame(rows, "stream string, frame_idx long, height long, width long, data array<int>")


@pytest.mark.parametrize("block,low,top,average", [(2, "0d", "2d", True), (4, "2d", "2d", True), (4, "1d", "1d", False)])
def test_numpy_path_equals_expressions(spark, block, low, top, average):
    import numpy as np

    from latticework.operators.base import UniformBase
    from latticework.plans import closed_loop

    cfg = StreamConfig(32, 32, chroma="mono", block=block, upsampler="cubic", scaling_low=low, scaling_top=top, average=average)
    rows, _ = planes_of(spark, 2, streams=("a",))
    src = spark.createDataFrame([(r[1], 0, i // 32, i % 32, v) for r in rows for i, v in enumerate(r[4])], "frame_idx long, plane long, y long, x long, v long")
    coded = codec.encode(src, cfg, 400, 200)
    want = {}
    for r in coded.output.collect():
        want.setdefault(r.frame_idx, np.zeros((32, 32), int))[r.y, r.x] = r.v
    control_ = closed_loop.Control(step_low=400, step_top=200, adapt=False, drop=False)
    for r in rows:
        state = closed_loop.State(400, 200)
        _, unit, base, out = closed_loop.code_picture(np.array(r[4]), r[1], state, cfg, control_, closed_loop.RawBase())
        assert (out.reshape(32, 32) == want[r[1]]).all()
        assert (closed_loop.read_picture_unit(unit, base, closed_loop.State(), cfg) == out).all()
    rough = UniformBase(16)
    frames = rough.frames(src, 8).collect()
    assert all(r.v == int(rough.plane(np.array([rows[r.frame_idx][4][r.y * 32 + r.x]]), 8)[0]) for r in frames)


def test_rate_follows_its_target(spark):
    from latticework.plans import closed_loop

    share_code(spark)
    cfg = StreamConfig(32, 32, chroma="mono", block=4, average=True)
    _, df = planes_of(spark, 24)
    rows = closed_loop.code_streams(df, "stream", cfg, closed_loop.Control(target_bytes=400, drop=False)).collect()
    assert len(rows) == 48
    late = [r.bytes for r in rows if r.frame_idx >= 12]
    assert abs(sum(late) / len(late) - 400) < 80
    assert len({r.step_top for r in rows}) > 1


def test_temporal_prediction_saves_bytes(spark):
    from latticework.plans import closed_loop

    share_code(spark)
    still = [("a", k, 32, 32, [int((x * 5 + y * y) % 180) for y in range(32) for x in range(32)]) for k in range(5)]
    df = spark.createDataFrame(still, "stream string, frame_idx long, height long, width long, data array<int>")
    size = {}
    for temporal in (False, True):
        cfg = StreamConfig(32, 32, chroma="mono", block=2, temporal=temporal)
        rows = closed_loop.code_streams(df, "stream", cfg, closed_loop.Control(adapt=False)).collect()
        size[temporal] = sum(r.bytes for r in rows)
        assert any(r.inter_blocks for r in rows) == temporal and all(r.sse <= r.base_only_sse for r in rows)
    assert size[True] < size[False]


def test_useless_frames_are_dropped(spark):
    from latticework.plans import closed_loop

    share_code(spark)
    flat = [("a", k, 32, 32, [100] * 1024) for k in range(3)]
    df = spark.createDataFrame(flat, "stream string, frame_idx long, height long, width long, data array<int>")
    rows = closed_loop.code_streams(df, "stream", StreamConfig(32, 32, chroma="mono"), closed_loop.Control()).collect()
    assert all(r.dropped and r.sse == r.base_only_sse for r in rows)
    watched, seen = metrics.watched(closed_loop.code_streams(df, "stream", StreamConfig(32, 32, chroma="mono"), closed_loop.Control()))
    assert watched.count() == 3 and seen.get["frames"] == 3 == seen.get["dropped"]


def test_chunks_of_layers_read_back():
    import numpy as np

    from latticework.plans import closed_loop

    rng = np.random.default_rng(4)
    levels = np.where(rng.random((200, 16)) < 0.1, rng.integers(-9, 9, (200, 16)), 0)
    levels[:, 3] = 0
    for order in (None, rng.permutation(200)):
        assert (closed_loop.unpack(closed_loop.pack(levels, order), 200, order) == levels).all()


@pytest.mark.parametrize("chroma,block,filtered", [("mono", 4, None), ("420", 2, None), ("422", 4, (3, 2)), ("444", 2, None)])
def test_streams_decode_to_the_coders_pictures(spark, chroma, block, filtered):
    import numpy as np

    from latticework.operators.base import UniformBase
    from latticework.plans import closed_loop

    share_code(spark)
    cfg = StreamConfig(64, 32, chroma=chroma, block=block, scaling_low="0d", temporal=True, filter_levels=filtered, multiplier=40).validate()
    rng, rows = np.random.default_rng(3), []
    n = sum(w * h for w, h in (cfg.size(0, p) for p in range(cfg.planes)))
    for stream in ("a", "b"):
        still = rng.integers(0, 200, n)
        for k in range(12):
            rows.append((stream, k, (still + (rng.integers(0, 9, n) if k % 3 else 0) + (k // 5) * 20).tolist()))
        rows.append((stream, 12, [90] * n))
    df = spark.createDataFrame(rows, "stream string, frame_idx long, data array<int>").repartition(5)
    coded = closed_loop.code_streams(df, "stream", cfg, closed_loop.Control(refresh_every=5, target_bytes=900), UniformBase(16), stream=True).cache()
    want = {(r.stream, r.frame_idx): r.output for r in coded.collect()}
    got = {(r.stream, r.frame_idx): r.data for r in closed_loop.decode_streams(coded, "stream", cfg).collect()}
    assert got == want and len(got) == 26
    rows = coded.collect()
    assert any(r.inter_blocks for r in rows) and all(r.sse <= r.base_only_sse for r in rows)


def test_planes_of_several_sizes_decode(spark):
    import numpy as np

    cfg = StreamConfig(32, 32, chroma="420", block=4, scaling_low="0d", multiplier=40, average=False).validate()
    rng = np.random.default_rng(8)
    rows = [(0, p, y, rng.integers(0, 255, cfg.size(0, p)[0]).tolist()) for p in range(3) for y in range(cfg.size(0, p)[1])]
    src = spark.createDataFrame(rows, "frame_idx long, plane long, y long, vals array<long>")
    coded = codec.encode(src, cfg, 500, 300, lambda_div=4)
    decoded = codec.decode(coded.base, codec.chunks(coded, cfg), cfg, 500, 300)
    same = {r.plane: r.max_diff for r in metrics.squared_error(metrics.paired(coded.output, decoded), ["plane"]).collect()}
    assert same == {0: 0, 1: 0, 2: 0}


def test_frames_not_worth_coding_are_found_early(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    cfg = StreamConfig(128, 128, chroma="mono", block=4, scaling_low="0d", average=False).validate()
    table = codec.tables(cfg, 300, 200)[0][0]
    kinds = {0: lambda: rng.integers(5000, 9000, 128), 1: lambda: np.zeros(128, int), 2: lambda: np.full(128, 350)}
    rows = [(f, 0, y, kinds[f]().tolist()) for f in kinds for y in range(128)]
    left = spark.createDataFrame(rows, "frame_idx long, plane long, y long, vals array<long>")
    assert {r.frame_idx: r.dropped for r in codec.early_drops(left, cfg, 200, table).collect()} == {0: True, 1: True, 2: False}
    src = spark.createDataFrame([(0, 0, y, [7] * 128) for y in range(128)], left.schema)
    coded = codec.encode(src, cfg, 300, 200, drop_early=True)
    assert codec.chunks(coded, cfg).count() == 0


def test_units_wait_for_their_pictures(spark, tmp_path):
    """Pictures and units of two streams in files that are read one a batch, units late and early."""
    import random

    from latticework.streaming import stateful

    rng = random.Random(2)
    rows, want = [], {}
    for s in ("a", "b"):
        order = list(range(12))
        rng.shuffle(order)
        rows += [(s, d, p, None) for d, p in enumerate(order)] + [(s, None, p, 10 * p + 1) for p in range(12)]
        total = 0
        for d, p in enumerate(order):
            total += 10 * p + 1
            want[s, d] = (p, 10 * p + 1, total)
    rng.shuffle(rows)
    schema = "s string, decode_idx long, poc long, size long"
    for k in range(6):
        spark.createDataFrame(rows[k::6], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    q = stateful.reorder(stream, "s", "decode_idx", "poc", "size").writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.s, r.decode_idx): (r.poc, r["size"], r.written) for r in out} == want
    assert all([r.decode_idx for r in out if r.s == s] == list(range(12)) for s in ("a", "b"))


def test_file_to_file(spark, tmp_path):
    """A raw video coded into units, base and a two-track file, and decoded from the first two."""
    import numpy as np

    from latticework.operators.base import UniformBase
    from latticework.plans import closed_loop, files
    from latticework.sources import container

    rng, frames, size = np.random.default_rng(6), 7, 64 * 32 * 3 // 2
    still = rng.integers(0, 200, size)
    raw = b"".join((still + rng.integers(0, 12, size)).astype("u1").tobytes() for _ in range(frames))
    path = {k: str(tmp_path / k) for k in ("in.yuv", "out.lvc", "base.yuv", "coder.yuv", "out.mp4", "decoded.yuv")}
    (tmp_path / "in.yuv").write_bytes(raw)
    cfg = StreamConfig(64, 32, block=2, scaling_low="0d", temporal=True)
    rows = files.encode_file(spark, path["in.yuv"], path["out.lvc"], cfg, closed_loop.Control(refresh_every=3), UniformBase(8), path["base.yuv"], path["coder.yuv"], path["out.mp4"], width=64, height=32, format="420").collect()
    assert len(rows) == frames and files.decode_file(spark, path["out.lvc"], path["base.yuv"], path["decoded.yuv"], cfg) == frames
    made = (tmp_path / "decoded.yuv").read_bytes()
    assert made == (tmp_path / "coder.yuv").read_bytes() and len(made) == len(raw)
    error = int(((np.frombuffer(made, "u1").astype(int) - np.frombuffer(raw, "u1")) ** 2).sum())
    assert error == sum(r.sse for r in rows)
    movie = (tmp_path / "out.mp4").read_bytes()
    media = next((s, e) for k, s, e in container.boxes(movie) if k == "mdat")
    assert media[1] == len(movie) and movie[media[0] : media[0] + 64] == (tmp_path / "base.yuv").read_bytes()[:64]
