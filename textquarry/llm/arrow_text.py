"""Whole texts of Arrow batches as flat numpy byte arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20


@dataclass
class Chunk:
    """Texts ``first`` up to ``first + len(ends) - 1`` of a batch, one behind the other."""

    first: int
    data: np.ndarray
    ends: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]])


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into runs of whole texts of about ``limit`` bytes; null is empty.

    A text longer than that is a run of its own.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        ends = offsets[at + 1 : to + 1] - offsets[at]
        yield Chunk(at, data[offsets[at] : offsets[to]], ends)
        at = to
