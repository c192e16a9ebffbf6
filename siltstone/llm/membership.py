"""A membership filter over 64-bit keys: bounded in size, so it may be broadcast whatever the data's size; it never misses a key."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, mix

#: 2**27 bits are 16 MB; with more keys than that holds, more strangers pass and the joins after it see more rows.
MOST_BITS = 27


def _slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(keys.view(U))
    return (x & U(bits - 1)).astype(np.int64), ((x >> U(32)) & U(bits - 1)).astype(np.int64)


def build(keys: DataFrame) -> np.ndarray:
    """The filter of a one-column table of longs, made by bitwise or on the executors."""
    n = keys.count()
    bits = 1 << min(MOST_BITS, max(16, math.ceil(math.log2(max(1, n) * 16))))

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64)
            at = np.unique(np.concatenate(_slots(x, bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((U(1) << (at & 63).astype(U)).view(np.int64))], ["word", "bit"])

    rows = keys.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits >> 6, U)
    out[rows.column("word").to_numpy()] = rows.column("bit").to_numpy().view(U)
    return out


def maybe(filt: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    a, b = _slots(keys.view(np.int64), len(filt) << 6)
    return ((filt[a >> 6] >> (a & 63).astype(U)) & (filt[b >> 6] >> (b & 63).astype(U)) & U(1)).astype(bool)
