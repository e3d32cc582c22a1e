"""A bitmap of hashes of fixed size, for tasks that forget what cannot match; exact joins decide afterwards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bits of a bitmap, as a power of two: 8 MB
BITS = 26


def of_hashes(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits of the hashes' first ``BITS`` bits; the driver gets at most 2 ** (BITS - 6) rows, however many hashes there are."""
    place = F.shiftrightunsigned(column, 64 - BITS)
    words = hashes.select(F.shiftrightunsigned(place, 6).cast("int").alias("word"),
                          F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def hits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those of the bitmap."""
    place = hashes.view(np.uint64) >> np.uint64(64 - BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
