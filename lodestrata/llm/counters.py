"""Counters of fixed size over all documents: how common a hash is, about. They order and route, and decide no result."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = 1 << 22
_PART = 1 << 16
PARTS = COUNTERS // _PART


def cells(h: np.ndarray) -> np.ndarray:
    """The counters of hashes."""
    return (h & np.uint64(COUNTERS - 1)).astype(np.int64)


def packed(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """``part, counts`` of a task's counters (uint32)."""
    blobs = [zlib.compress(counts[p * _PART : (p + 1) * _PART].tobytes(), 1) for p in range(PARTS)]
    return pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())


def scale(parts: DataFrame, tasks: int) -> np.ndarray:
    """The counters of all tasks, summed and put on a logarithmic scale of one byte: 6 * log2(1 + count).

    They are summed in two steps, so that no group gets more than about the square root of ``tasks`` rows.
    """

    def add(pdf: pd.DataFrame) -> np.ndarray:
        total = np.zeros(_PART, dtype=np.uint64)
        for x in pdf["counts"]:
            got = np.frombuffer(zlib.decompress(x), dtype=np.uint8)
            total += got.view(np.uint64 if len(got) == 8 * _PART else np.uint32)
        return total

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "counts": [zlib.compress(add(pdf).tobytes(), 1)]})

    def scaled(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.minimum(255, 6 * np.log2(1 + add(pdf).astype(np.float64))).astype(np.uint8)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "scale": [out.tobytes()]})

    dealt = parts.withColumn("_lot", F.pmod(F.xxhash64("counts"), F.lit(max(1, math.isqrt(tasks)))))
    first = dealt.groupBy("part", "_lot").applyInPandas(some, "part int, counts binary")
    out = np.zeros(COUNTERS, dtype=np.uint8)
    for r in first.groupBy("part").applyInPandas(scaled, "part int, scale binary").collect():  # PARTS rows
        out[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["scale"], dtype=np.uint8)
    return out


def counted(scale: np.ndarray) -> np.ndarray:
    """About the counts that a scale stands for."""
    return np.exp2(scale / 6.0) - 1
