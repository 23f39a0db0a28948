"""Known vectors and round trips of the parts that need no session."""

import random

import pytest

from latticework.functions import framing, payload, prefix
from latticework.functions.bits import BitReader, BitWriter, read_seven_bit, seven_bit
from latticework.functions.quantizers import table_for
from latticework.functions.transforms import DENOMINATOR, forward, inverse
from latticework.operators.control import gop_length
from latticework.plans.config import PictureConfig, StreamConfig, read_global, read_picture
from latticework.sources import container


def test_bits():
    assert BitWriter().put(0b1010, 4).put(0b110011, 6).bytes() == b"\xac\xc0"
    assert BitWriter().put(0b101, 3).align().bytes() == b"\xa0"
    rng = random.Random(1)
    fields = [(rng.getrandbits(w), w) for w in (rng.randrange(1, 33) for _ in range(500))]
    out = BitWriter()
    for v, w in fields:
        out.put(v, w)
    src = BitReader(out.bytes())
    assert [src.take(w) for _, w in fields] == [v for v, _ in fields]
    with pytest.raises(ValueError):
        BitWriter().put(4, 2)
    with pytest.raises(ValueError):
        BitReader(b"").take(1)


@pytest.mark.parametrize("v", [0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 32) - 1])
def test_seven_bit_groups(v):
    data = seven_bit(v)
    assert read_seven_bit(data, 0) == (v, len(data))


def test_unit_with_escapes():
    data = bytes([0, 0, 0, 1, 2, 3, 3, 4, 0xAA, 0, 0, 5])
    made = framing.unit(False, [(3, data)])
    assert made[:5] == bytes([0, 0, 1, 0x79, 0xFF]) and made[5:7] == bytes([0xE3, 0x0C]) and made[-1] == 0x80
    assert framing.read_unit(made) == (False, [(3, data)])
    assert framing.unit(True, [])[3] == 0x7B
    rng = random.Random(2)
    for _ in range(300):
        blocks = [(rng.randrange(7), bytes(rng.choice((0, 0, 0, 1, 2, 3, 4, 255)) for _ in range(rng.randrange(40)))) for _ in range(rng.randrange(4))]
        assert framing.read_unit(framing.unit(True, blocks)) == (True, blocks)


@pytest.mark.parametrize("size", [2, 4])
@pytest.mark.parametrize("line", [False, True])
def test_transforms_invert(size, line):
    rng = random.Random(size)
    for _ in range(50):
        r = [rng.randrange(-200, 200) for _ in range(size * size)]
        back = inverse(forward(r, size, line), size, line, clip=lambda x: x)
        assert back == [DENOMINATOR[size] * x for x in r]


def test_known_transform():
    assert inverse([8] + [0] * 15, 4, True, clip=lambda x: x)[:8] == [8, 8, 0, 0, 8, 8, 0, 0]


def test_step_tables():
    step, offset, zone = table_for(256, (13,))[0][0]
    assert (step, zone, offset) == (271, -13, 13)
    inter = table_for(1000, (0,), temporal=True)
    assert inter[0][0] != inter[1][0]


def test_header_widths():
    assert [prefix.width_of_range(x) for x in (0, 1, 2, 3, 4, 7, 8, 15, 16, 31)] == [0, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_special_tables():
    out = BitWriter()
    prefix.Table.of([42, 42]).write(out)
    assert len(out.bytes()) == 3
    out = BitWriter()
    prefix.Table.of([]).write(out)
    assert len(out.bytes()) == 2


@pytest.mark.parametrize("count", [2, 26, 31, 32, 40, 256])
def test_prefix_tables_read_back(count):
    rng = random.Random(count)
    symbols = [rng.randrange(count) for _ in range(count * 9)] + list(range(count))
    table, out = prefix.Table.of(symbols), BitWriter()
    table.write(out)
    for s in symbols:
        table.put(out, s)
    src = BitReader(out.bytes())
    read = prefix.Table.read(src)
    assert [read.take(src) for _ in symbols] == symbols


@pytest.mark.parametrize("raw", [False, True])
def test_coefficients(raw):
    for events in ([(5, 3), (-2, 0), (100, 1), (-100, 10)], [(0, 16382), (1, 16384), (-8192, 0), (8191, 1_000_000)], [(0, 0)]):
        total = sum(z + 1 for _, z in events)
        assert prefix.read_coefficients(prefix.coefficient_chunk(events, raw), total, raw) == events


def test_sizes_and_signals():
    sizes = [5, 127, 128, 129, 16383, 1, 1000]
    assert prefix.read_sizes(prefix.size_chunk(sizes), len(sizes))[0] == sizes
    for deltas in ([5, -5, 63, -64, 1000, -1000, 8191, -8192], [253, -214, 97, -98]):
        assert prefix.read_sizes(prefix.size_chunk(deltas, True), len(deltas), True)[0] == deltas
    with pytest.raises(ValueError):
        prefix.size_chunk([16384])
    for runs in ([(0, 3), (1, 2), (0, 5), (1, 1)], [(0, 57600)], [(1, 1)]):
        assert prefix.read_signals(prefix.signal_chunk(runs), sum(n for _, n in runs)) == runs
    with pytest.raises(ValueError):
        prefix.signal_chunk([(0, 1), (0, 2)])


@pytest.mark.parametrize("packed_flags", [False, True])
@pytest.mark.parametrize("packed_sizes", [0, 1, 2])
def test_tiled_payload(packed_flags, packed_sizes):
    rng = random.Random(packed_sizes)
    chunks, tiles = {}, {}
    for slot in payload.slots(3, 4, True):
        tiles[slot] = 4 if slot[0] == 0 else 1
        chunks[slot] = [payload.Chunk(rng.randbytes(rng.choice((0, 1, 7, 300)))) for _ in range(tiles[slot])]
    data = payload.write_tiled(chunks, 3, 4, True, packed_flags, packed_sizes)
    assert payload.read_tiled(data, tiles, 3, 4, True, packed_flags, packed_sizes) == chunks


def test_plain_payload():
    chunks = {slot: [payload.Chunk(b"x" * (k * 37 % 200))] for k, slot in enumerate(payload.slots(1, 16, True))}
    assert payload.read_plain(payload.write_plain(chunks, 1, 16, True), 1, 16, True) == chunks


def test_flag_runs():
    for flags in ([True], [False] * 300 + [True] + [False], [True, False] * 9):
        assert payload.read_flag_runs(payload.flag_runs(flags), 0, len(flags))[0] == flags


def test_streams_split_into_access_units():
    unit = lambda kind, n, long: (b"\0" if long else b"") + b"\0\0\1" + bytes([0, kind << 3 | 1]) + b"\x55" * n
    data = unit(15, 4, True) + unit(0, 9, False) + unit(1, 5, True) + unit(8, 3, False)
    parts = framing.split_units(data)
    assert len(parts) == 4 and sum(n for _, n in parts) == len(data) and b"".join(data[s : s + n] for s, n in parts) == data
    aus = list(framing.access_units(data))
    assert len(aus) == 3 and aus[0][0] == 0 and sum(n for _, n in aus) == len(data)
    assert framing.split_units(b"") == [] and list(framing.access_units(unit(15, 2, False))) == [(0, 7)]
    assert framing.strip_start(b"\0\0\0\1ab") == b"ab" == framing.strip_start(b"\0\0\1ab") == framing.strip_start(b"ab")


def test_configuration():
    cfg = StreamConfig(1920, 1088)
    assert cfg.validate() is cfg and cfg.size(1) == (960, 544) and cfg.size(2, 1) == (240, 136)
    for bad in (StreamConfig(0, 16), StreamConfig(30, 32), StreamConfig(64, 64, tiles="custom"), StreamConfig(64, 64, tiles="custom", tile_size=(12, 8))):
        with pytest.raises(ValueError):
            bad.validate()
    assert StreamConfig(3840, 2160).resolution == 40 and StreamConfig(3840, 2161).resolution == 63
    assert read_global(cfg.global_bits(), cfg.sequence_bits()) == cfg
    pic = PictureConfig(512, 256, True, (tuple(range(16)), tuple(range(16, 32))))
    assert read_picture(pic.bits(), 16) == pic


def test_container_holds_its_samples():
    base, extra = [b"a" * n for n in (5, 7, 9)], [b"b" * n for n in (2, 4, 1, 8)]
    data = container.mux(base, extra, (64, 32), (25, 1), [0, 2, 1], container.colour_codes("bt2020", "smpte2084", "bt2020nc"))
    top = {k: (s, e) for k, s, e in container.boxes(data)}
    assert list(top) == ["ftyp", "moov", "mdat"]
    tracks = [(s, e) for k, s, e in container.boxes(data, *top["moov"]) if k == "trak"]
    for (s, e), samples in zip(tracks, (base, extra[:3])):
        for kind in ("mdia", "minf", "stbl"):
            s, e = next((a, b) for k, a, b in container.boxes(data, s, e) if k == kind)
        table = {k: data[a:b] for k, a, b in container.boxes(data, s, e)}
        n = int.from_bytes(table["stco"][4:8], "big")
        places = [int.from_bytes(table["stco"][8 + 4 * i : 12 + 4 * i], "big") for i in range(n)]
        assert [data[p : p + len(x)] for p, x in zip(places, samples)] == samples
        assert "ctts" in table and int.from_bytes(table["stsz"][8:12], "big") == 3


def test_group_lengths():
    assert [gop_length(s, r) for s, r in ((1, 25), (0.3, 25), (0, 25), (1, 29.97))] == [25, 8, 1, 30]


#: Bytes of chunks worked out by hand from the format: table headers, then codes.
def bits(text):
    text = text.replace(" ", "")
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def test_known_chunks():
    none, one = "11111 11111", lambda b: f"00000 00000 {b:08b}"
    # one level of 1: its only symbol is (1 + 32) * 2 and takes no bits
    assert prefix.coefficient_chunk([(1, 0)]) == bits(one(66) + none + none)
    # 1 with 3 zeros behind it: the high bit says that a run follows
    assert prefix.coefficient_chunk([(1, 3)]) == bits(one(66 | 128) + none + one(3))
    # 100 and 300 zeros: two level bytes, two run bytes with codes 0 and 1 (longest length, smallest symbol first)
    wide = 100 + 8192
    table = "00001 00001 0 00010" + f"{44:08b}" + f"{130:08b}"
    assert prefix.coefficient_chunk([(100, 300)]) == bits(one(wide % 128 * 2 + 1) + one(wide // 128 | 128) + table + "1 0")
    assert prefix.coefficient_chunk([(1, 3), (-2, 0)], raw=True) == bytes([66 | 128, 3, 60])
    # sizes 5 and 300: three symbols of two contexts
    assert prefix.size_chunk([5]) == bits(one(10) + none)
    assert prefix.size_chunk([300]) == bits(one(300 % 128 * 2 + 1) + one(2))
    assert prefix.size_chunk([-1], signed=True) == bits(one(254) + none)
    assert prefix.size_chunk([-70], signed=True) == bits(one(-70 % 128 * 2 + 1) + one(127 | 128))
    # one run of 3 blocks with signal 1, then one of 200 with signal 0
    runs = "00001 00001 0 00010" + f"{72:08b}" + f"{129:08b}"
    assert prefix.signal_chunk([(1, 3), (0, 200)]) == bits(runs + one(3) + "00000001" + "1 0")


def test_known_configuration():
    cfg = StreamConfig(1920, 1080, 8, 10, "420", 4, "linear", scaling_low="0d", scaling_top="2d", average=True, temporal=True)
    # planes, resolution 26, block | chroma, depths, flags | temporal, upsampler, filter, scalings, tiles | colour types
    assert cfg.global_bits() == bits("1 011010 1  01 00 01 0 1  0 1 001 0 00  10 00 00 0 0  0001 0000")
    assert cfg.sequence_bits() == bits("0000 0011 00 0 00000")
    plane = PictureConfig(1000, 300, True, ((1, 2, 3, 4), (5, 6, 7, 8)))
    assert plane.bits() == bits("0 101 0 0 1 1" + f"{300:015b} 0 {1000:015b} 0" + "".join(f"{k:08b}" for k in range(1, 9)))


def test_rates_by_size():
    from latticework.operators.control import total_rate

    assert [total_rate(*s) for s in ((3840, 2160), (1920, 1080), (640, 360), (15360, 8640))] == [7000, 1750, 800, 30000]
