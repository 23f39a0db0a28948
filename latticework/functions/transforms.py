"""2x2 and 4x4 block transforms over lists of columns.

All are built from one four-point Hadamard butterfly and, for horizontal-only
scaling, its one-dimensional variant.  Forward transforms give integer
numerators over 4 (2x2) or 16 (4x4); inverses saturate to 16 bits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixedpoint import sat16

#: Rows of the four-point transforms (fixed values).
HADAMARD = ((1, 1, 1, 1), (1, -1, 1, -1), (1, 1, -1, -1), (1, -1, -1, 1))
LINE = ((2, 2, 0, 0), (1, -1, 1, -1), (1, -1, -1, 1), (0, 0, 2, 2))
LINE_BACK = ((1, 1, 1, 0), (1, -1, -1, 0), (0, 1, -1, 1), (0, -1, 1, 1))
DENOMINATOR = {2: 4, 4: 16}


def combine(weights: Sequence[int], terms: Sequence):
    """Weighted sum of columns (or of numbers) without terms of weight 0."""
    parts = [t if w == 1 else t * w for w, t in zip(weights, terms) if w]
    return reduce(lambda a, b: a + b, parts)


def apply(matrix: Sequence[Sequence[int]], terms: Sequence) -> list:
    return [combine(row, terms) for row in matrix]


def _swap(rows: Sequence) -> list:
    """Order of the one-dimensional stage inside a 4x4 block: its last two parts change places."""
    return [rows[0], rows[1], rows[3], rows[2]]


def forward(residual: Sequence, size: int, line: bool = False) -> list:
    """Numerators of the coefficients of a block given in residual order."""
    if size == 2:
        return apply(LINE if line else HADAMARD, residual)
    first = _swap(LINE) if line else HADAMARD
    quads = [apply(first, residual[4 * q : 4 * q + 4]) for q in range(4)]
    return [c for i in range(4) for c in apply(HADAMARD, [quad[i] for quad in quads])]


def inverse(coefficients: Sequence, size: int, line: bool = False, clip=sat16) -> list:
    """Residual of a block from its (dequantized) coefficients."""
    if size == 2:
        return [clip(x) for x in apply(LINE_BACK if line else HADAMARD, coefficients)]
    groups = [apply(HADAMARD, coefficients[4 * g : 4 * g + 4]) for g in range(4)]
    last = [_swap(row) for row in LINE_BACK] if line else HADAMARD
    return [clip(x) for part in range(4) for x in apply(last, [g[part] for g in groups])]


def names(prefix: str, size: int) -> list[str]:
    return [f"{prefix}{k}" for k in range(size * size)]


def columns(prefix: str, size: int) -> list[Column]:
    return [F.col(n).cast("bigint") for n in names(prefix, size)]
