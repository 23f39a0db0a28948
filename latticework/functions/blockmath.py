"""The arithmetic of frames and blocks on numpy arrays.

For work that runs along a stream and so cannot be a plan of expressions:
closed-loop coding and temporal prediction.  Blocks are rows of an int64 array,
all of a frame (or of a band of it) at once.  The expression path
(``transforms``, ``quantizers``, ``operators.stencil``) says the same; tests
hold the two together.
"""

from __future__ import annotations

import numpy as np

from .transforms import HADAMARD, LINE, LINE_BACK

_H = np.array(HADAMARD)
_L, _B = np.array(LINE), np.array(LINE_BACK)
_ORDER = [0, 1, 3, 2]
#: Residual places at the corners and along the sides of a 4x4 block (fixed values).
CORNERS, SIDES = (0, 5, 10, 15), (1, 4, 7, 13, 2, 8, 11, 14)


def matrices(size: int, line: bool) -> tuple[np.ndarray, np.ndarray]:
    """Forward (numerator) and inverse matrices on residual-ordered blocks."""
    if size == 2:
        return (_L, _B) if line else (_H, _H)
    first, last = (_L[_ORDER], _B[:, _ORDER]) if line else (_H, _H)
    forward, back = np.zeros((16, 16), int), np.zeros((16, 16), int)
    for i in range(4):
        for k in range(4):
            for q in range(4):
                forward[4 * i + k, 4 * q : 4 * q + 4] += _H[k, q] * first[i]
                back[4 * k + i, 4 * q : 4 * q + 4] += last[i, q] * _H[k]
    return forward, back


def clip16(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -32768, 32767)


def index_map(size: int) -> np.ndarray:
    """Position in a block row-major -> residual order."""
    y, x = np.divmod(np.arange(size * size), size)
    k = (x & 1) | (y & 1) << 1
    return k if size == 2 else k | (x >> 1) << 2 | (y >> 1) << 3


def to_blocks(plane: np.ndarray, size: int) -> np.ndarray:
    """Blocks of a plane in raster order, each in residual order."""
    h, w = plane.shape
    flat = plane.reshape(h // size, size, w // size, size).swapaxes(1, 2).reshape(-1, size * size)
    out = np.empty_like(flat)
    out[:, index_map(size)] = flat
    return out


def to_plane(blocks: np.ndarray, size: int, width: int, height: int) -> np.ndarray:
    flat = blocks[:, index_map(size)]
    return flat.reshape(height // size, width // size, size, size).swapaxes(1, 2).reshape(height, width)


def block_order(width: int, height: int, size: int, area: int = 32) -> np.ndarray:
    """Raster indices of blocks in the order that walks areas of 32 by 32 one after the other, edge areas cropped."""
    y, x = np.divmod(np.arange(height // size * (width // size)), width // size)
    per = area // size
    return np.lexsort((x, y, x // per, y // per))


def quantize(num: np.ndarray, denom: int, step: np.ndarray, zone: np.ndarray) -> np.ndarray:
    level = (2 * np.abs(num) + denom * np.abs(2 * zone + step)) // (2 * denom * step)
    return np.clip(np.where(num == 0, 0, np.sign(num) * level), -8192, 8191)


def dequantize(level: np.ndarray, step: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return clip16(level * step + np.sign(level) * offset)


def choose_levels(num: np.ndarray, denom: int, level: np.ndarray, step: np.ndarray, offset: np.ndarray, lambda_div: int = 16) -> np.ndarray:
    """Least distortion plus rate among neighbouring levels; first of equals, zero last."""
    rate = (step * step // lambda_div) * denom * denom

    def cost(q: np.ndarray) -> np.ndarray:
        error = (q * step + np.sign(q) * offset) * denom - num
        return error * error + rate * np.where(q == 0, 0, np.where(np.abs(q) <= 32, 9, 17))

    best, least = level - 1, cost(level - 1)
    for q in (level, level + 1):
        now = cost(q)
        best, least = np.where(now < least, q, best), np.minimum(now, least)
    best = np.where((np.abs(level) <= 2) & (num * num < least), 0, best)
    fixed = (np.abs(level) > 4) | (level == 0) & (num * num <= rate * 9)
    return np.clip(np.where(fixed, level, best), -8192, 8191)


def softened(made: np.ndarray, corner: int, side: int) -> np.ndarray:
    """4x4 blocks with corners and sides drawn back by sixteenths, as ``operators.blocks.soften``."""
    scale = np.full(16, 16)
    scale[list(CORNERS)], scale[list(SIDES)] = 16 - corner, 16 - side
    return np.where(scale == 16, made, clip16(made * scale >> 4))


def code(residual: np.ndarray, size: int, line: bool, table: list[tuple[int, int, int]], rdoq: bool = True, improve: bool = True, lambda_div: int = 16, soft: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels, reconstruction and coefficient numerators of residual blocks."""
    step, offset, zone = (np.array(c, np.int64) for c in zip(*table))
    forward, back = matrices(size, line)
    denom = size * size
    num = residual @ forward.T
    level = quantize(num, denom, step, zone)
    if rdoq:
        level = choose_levels(num, denom, level, step, offset, lambda_div)
    dead = np.abs(residual).max(1) < (step // 2 + offset).min()
    level[dead] = 0
    made = clip16(dequantize(level, step, offset) @ back.T)
    if soft is not None and size == 4:
        made = softened(made, *soft)
    if improve:
        worse = ((residual - made) ** 2).sum(1) >= (residual**2).sum(1)
        level[worse], made[worse] = 0, 0
    num[dead] = 0
    return level, made, num


def downscale(plane: np.ndarray, mode: str, peak: int) -> np.ndarray:
    if mode == "0d":
        return plane
    h, w = plane.shape
    high = (h + 1) // 2 * 2 if mode == "2d" else h
    wide = np.full((high, (w + 1) // 2 * 2), -1, np.int64)
    wide[:h, :w] = plane
    parts = wide.reshape(high // 2, 2, -1, 2).swapaxes(1, 2).reshape(high // 2, -1, 4) if mode == "2d" else wide.reshape(high, -1, 2)
    n = (parts >= 0).sum(2)
    return np.clip((np.where(parts >= 0, parts, 0).sum(2) + n // 2) // n, 0, peak)


def _stretch(x: np.ndarray, kernel: tuple[int, ...]) -> np.ndarray:
    """Twice the columns."""
    e = np.pad(x, ((0, 0), (2, 2)), "edge")
    n, k = x.shape[1], kernel
    at = lambda d: e[:, 2 + d : 2 + d + n]
    even = at(-2) * k[3] + at(-1) * k[2] + at(0) * k[1] + at(1) * k[0]
    odd = at(-1) * k[0] + at(0) * k[1] + at(1) * k[2] + at(2) * k[3]
    out = np.empty((x.shape[0], 2 * n), np.int64)
    out[:, 0::2], out[:, 1::2] = even, odd
    return np.clip((out + 0x2000) >> 14, -16384, 16383)


def upscale(plane: np.ndarray, mode: str, kernel: tuple[int, ...], average: bool) -> np.ndarray:
    if mode == "0d":
        return plane
    tall = _stretch(plane.T, kernel).T if mode == "2d" else plane
    out = _stretch(tall, kernel)
    if average:
        if mode == "2d":
            mean = (out[0::2, 0::2] + out[0::2, 1::2] + out[1::2, 0::2] + out[1::2, 1::2] + 2) >> 2
            shift = np.repeat(np.repeat(plane - mean, 2, 0), 2, 1)
        else:
            shift = np.repeat(plane - ((out[:, 0::2] + out[:, 1::2] + 1) >> 1), 2, 1)
        out = clip16(out + shift)
    return out


def to_internal(v: np.ndarray, depth: int) -> np.ndarray:
    return (v.astype(np.int64) << 15 - depth) - 0x4000


def to_sample(s: np.ndarray, depth: int) -> np.ndarray:
    return np.clip(((s + (1 << 14 - depth)) >> 15 - depth) + (1 << depth - 1), 0, (1 << depth) - 1)
