"""Stream configuration: validation, geometry, and its bits."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..functions.bits import BitReader, BitWriter

#: Codes of the stream format (fixed values).
SCALING = {"0d": 0, "1d": 1, "2d": 2}
UPSAMPLER = {"nearest": 0, "linear": 1, "cubic": 2, "modified_cubic": 3, "adaptive": 4}
CHROMA = {"mono": 0, "420": 1, "422": 2, "444": 3}
TILES = {"none": 0, "512x256": 1, "1024x512": 2, "custom": 3}
TILE_SIZE = {"512x256": (512, 256), "1024x512": (1024, 512)}
CUSTOM_RESOLUTION = 63
MODIFIER, MULTIPLIER = 48, 64
#: Sizes with a code of their own, from code 1 on (fixed values).
RESOLUTIONS = (
    (360, 200), (400, 240), (480, 320), (640, 360), (640, 480), (768, 480), (800, 600), (852, 480), (854, 480), (856, 480),
    (960, 540), (960, 640), (1024, 576), (1024, 600), (1024, 768), (1152, 864), (1280, 720), (1280, 800), (1280, 1024), (1360, 768),
    (1366, 768), (1400, 1050), (1440, 900), (1600, 1200), (1680, 1050), (1920, 1080), (1920, 1200), (2048, 1080), (2048, 1152), (2048, 1536),
    (2160, 1440), (2560, 1440), (2560, 1600), (2560, 2048), (3200, 1800), (3200, 2048), (3200, 2400), (3440, 1440), (3840, 1600), (3840, 2160),
    (3840, 2400), (4096, 2160), (4096, 3072), (5120, 2880), (5120, 3200), (5120, 4096), (6400, 4096), (6400, 4800), (7680, 4320), (7680, 4800),
)


@dataclass(frozen=True)
class StreamConfig:
    width: int
    height: int
    base_depth: int = 8
    depth: int = 8
    chroma: str = "420"
    block: int = 4
    upsampler: str = "linear"
    taps: tuple[int, int, int, int] = (0, 16384, 0, 0)
    scaling_low: str = "2d"
    scaling_top: str = "2d"
    tiles: str = "none"
    tile_size: tuple[int, int] = (0, 0)
    tile_flags_packed: bool = False
    tile_sizes_packed: int = 0
    average: bool = True
    temporal: bool = False
    modifier: int = MODIFIER
    multiplier: int = MULTIPLIER
    filter_levels: tuple[int, int] | None = None
    profile: int = 0
    level: int = 3
    sublevel: int = 0

    @property
    def planes(self) -> int:
        return 1 if self.chroma == "mono" else 3

    @property
    def resolution(self) -> int:
        size = (self.width, self.height)
        return RESOLUTIONS.index(size) + 1 if size in RESOLUTIONS else CUSTOM_RESOLUTION

    def shift(self, plane: int) -> tuple[int, int]:
        """Subsampling of a plane, as bits of width and height."""
        return {"420": (1, 1), "422": (1, 0)}.get(self.chroma, (0, 0)) if plane else (0, 0)

    def size(self, level: int, plane: int = 0) -> tuple[int, int]:
        """Width and height of a plane at level 0 (full), 1 or 2 (base)."""
        w, h = self.width, self.height
        for mode in (self.scaling_top, self.scaling_low)[:level]:
            w, h = (w + 1) // 2 if mode != "0d" else w, (h + 1) // 2 if mode == "2d" else h
        a, b = self.shift(plane)
        return (w + (1 << a) - 1) >> a, (h + (1 << b) - 1) >> b

    def tile(self, plane: int = 0) -> tuple[int, int] | None:
        if self.tiles == "none":
            return None
        w, h = self.tile_size if self.tiles == "custom" else TILE_SIZE[self.tiles]
        a, b = self.shift(plane)
        return w >> a, h >> b

    def validate(self) -> StreamConfig:
        """Itself, or an error that says what does not fit."""
        if self.width <= 0 or self.height <= 0:
            raise ValueError("the size is zero")
        a, b = (1, 1) if self.chroma == "420" else (1, 0) if self.chroma == "422" else (0, 0)
        across = self.block * (2 if self.scaling_top != "0d" else 1) << a
        down = self.block * (2 if self.scaling_top == "2d" else 1) << b
        if self.width % across or self.height % down:
            raise ValueError(f"the size is not a multiple of {across}x{down}")
        for plane in range(self.planes):
            t = self.tile(plane)
            if t is not None and (0 in t or t[0] % self.block or t[1] % self.block):
                raise ValueError("the tile size is no multiple of the block size")
        return self

    # Bits -------------------------------------------------------------------

    def sequence_bits(self) -> bytes:
        out = BitWriter().put(self.profile, 4).put(self.level, 4).put(self.sublevel, 2).flag(False).put(0, 5)
        if 15 in (self.profile, self.level):
            out.put(0, 11)
        return out.bytes()

    def global_bits(self) -> bytes:
        out = BitWriter()
        three = self.planes == 3
        out.flag(three).put(self.resolution, 6).put(int(self.block == 4), 1)
        out.put(CHROMA[self.chroma], 2).put(self.base_depth // 2 - 4, 2).put(self.depth // 2 - 4, 2)
        out.flag(self.modifier != MODIFIER).flag(self.average)
        out.flag(False).flag(self.temporal).put(UPSAMPLER[self.upsampler], 3).flag(self.filter_levels is not None).put(SCALING[self.scaling_low], 2)
        out.put(SCALING[self.scaling_top], 2).put(TILES[self.tiles], 2).put(0, 2).flag(False).flag(self.multiplier != MULTIPLIER)
        if three:
            out.put(1, 4).put(0, 4)
        if self.modifier != MODIFIER:
            out.put(self.modifier, 8)
        if self.upsampler == "adaptive":
            for sign, tap in zip((-1, 1, 1, -1), self.taps):
                out.put(max(0, min(65535, sign * tap)), 16)
        if self.filter_levels is not None:
            out.put(self.filter_levels[0], 4).put(self.filter_levels[1], 4)
        if self.tiles != "none":
            if self.tiles == "custom":
                out.put(self.tile_size[0], 16).put(self.tile_size[1], 16)
            out.put(0, 5).flag(self.tile_flags_packed).put(self.tile_sizes_packed, 2)
        if self.resolution == CUSTOM_RESOLUTION:
            out.put(self.width, 16).put(self.height, 16)
        if self.multiplier != MULTIPLIER:
            out.put(self.multiplier, 8)
        return out.bytes()


def _name(codes: dict[str, int], code: int) -> str:
    return next(n for n, c in codes.items() if c == code)


def read_global(data: bytes, sequence: bytes | None = None) -> StreamConfig:
    """The configuration that ``global_bits`` (and ``sequence_bits``) wrote."""
    src = BitReader(data)
    three, resolution, block = src.flag(), src.take(6), 4 if src.flag() else 2
    chroma, base_depth, depth = _name(CHROMA, src.take(2)), src.take(2) * 2 + 8, src.take(2) * 2 + 8
    own_modifier, average = src.flag(), src.flag()
    src.flag()
    temporal, upsampler, filtered, low = src.flag(), _name(UPSAMPLER, src.take(3)), src.flag(), _name(SCALING, src.take(2))
    top, tiles = _name(SCALING, src.take(2)), _name(TILES, src.take(2))
    src.take(3)
    own_multiplier = src.flag()
    if three:
        src.take(8)
    out = StreamConfig(0, 0, base_depth, depth, chroma, block, upsampler, scaling_low=low, scaling_top=top, tiles=tiles, average=average, temporal=temporal)
    if own_modifier:
        out = replace(out, modifier=src.take(8))
    if upsampler == "adaptive":
        out = replace(out, taps=tuple(sign * src.take(16) for sign in (-1, 1, 1, -1)))
    if filtered:
        out = replace(out, filter_levels=(src.take(4), src.take(4)))
    if tiles != "none":
        if tiles == "custom":
            out = replace(out, tile_size=(src.take(16), src.take(16)))
        src.take(5)
        out = replace(out, tile_flags_packed=src.flag(), tile_sizes_packed=src.take(2))
    w, h = (src.take(16), src.take(16)) if resolution == CUSTOM_RESOLUTION else RESOLUTIONS[resolution - 1]
    out = replace(out, width=w, height=h)
    if own_multiplier:
        out = replace(out, multiplier=src.take(8))
    if sequence is not None:
        s = BitReader(sequence)
        out = replace(out, profile=s.take(4), level=s.take(4), sublevel=s.take(2))
    return out


@dataclass(frozen=True)
class PictureConfig:
    """What a picture adds: step widths, refresh flag and both matrices."""

    step_low: int
    step_top: int
    refresh: bool
    matrices: tuple[tuple[int, ...], tuple[int, ...]]

    def bits(self) -> bytes:
        out = BitWriter().flag(False).put(5, 3).flag(False).flag(False).flag(self.refresh).flag(True)
        out.put(min(self.step_top, 32767), 15).flag(False).put(min(self.step_low, 32767), 15).flag(False)
        for m in (*self.matrices[0], *self.matrices[1]):
            out.put(m, 8)
        return out.bytes()


def read_picture(data: bytes, layers: int) -> PictureConfig:
    src = BitReader(data)
    src.take(6)
    refresh = src.flag()
    src.take(1)
    top = src.take(15)
    src.take(1)
    low = src.take(15)
    src.take(1)
    both = tuple(tuple(src.take(8) for _ in range(layers)) for _ in range(2))
    return PictureConfig(low, top, refresh, both)
