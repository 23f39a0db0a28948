"""The base layer's coder: what happens to base samples between coder and decoder.

A real video codec is outside Spark; a stream that has one joins its decoded
base frames here.  The stand-ins are the identity and a uniform quantizer.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixedpoint import clamp


class BaseCodec(Protocol):
    def frames(self, samples: DataFrame, depth: int) -> DataFrame: ...

    def plane(self, samples: np.ndarray, depth: int) -> np.ndarray: ...


class RawBase:
    """Lossless: the base as it is."""

    def frames(self, samples: DataFrame, depth: int) -> DataFrame:
        return samples

    def plane(self, samples: np.ndarray, depth: int) -> np.ndarray:
        return samples


class UniformBase:
    """Samples rounded to multiples of a step."""

    def __init__(self, step: int) -> None:
        self.step = step

    def frames(self, samples: DataFrame, depth: int) -> DataFrame:
        rounded = F.call_function("div", F.col("v") + self.step // 2, F.lit(self.step)) * self.step
        return samples.withColumn("v", clamp(rounded, 0, (1 << depth) - 1))

    def plane(self, samples: np.ndarray, depth: int) -> np.ndarray:
        return np.clip((samples + self.step // 2) // self.step * self.step, 0, (1 << depth) - 1)
