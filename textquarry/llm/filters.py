"""Filters of one bit for each place, whatever the input: what is not in one is certainly left out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 26


def bits_of(slots: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, eight to a byte, with a one for each of ``slots`` (slot from 0)."""
    slot = F.col("slot") + 1
    rows = (
        slots.groupBy(F.bitmap_bucket_number(slot).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
        .collect()
    )
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.bits), np.uint8)
        bits[(r.bucket - 1) * len(part) : r.bucket * len(part)] = part
    return bits


def has(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether the bit of each slot is one; the bytes are used as they are."""
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
