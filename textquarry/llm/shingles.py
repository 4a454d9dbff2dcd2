"""Word shingle sets of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

import functools

import numpy as np

from textquarry.llm.arrow_text import CHUNK_BYTES, Chunk

WIDTH = 5
_BASE = 0x5851F42D4C957F2D
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(5)
_LETTER = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = _RANDOM.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    up = np.full(size, _BASE, np.uint64)
    down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(32))


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash for each run of bytes begin..end, none of them empty."""
    size = 1 << (max(len(data), CHUNK_BYTES) - 1).bit_length()
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=sums[1:])
    value = (sums[end] - sums[begin]) * down[begin]
    return mixed(value + (end - begin).astype(np.uint64))


def word_spans(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a chunk begin and end; no word spans two texts."""
    data = chunk.data
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    inner = ~space[1:-1]
    first = space[:-2].copy()
    first[chunk.starts[chunk.starts < len(data)]] = True
    last = space[2:].copy()
    last[chunk.ends[chunk.ends > 0] - 1] = True
    return np.flatnonzero(inner & first), np.flatnonzero(inner & last) + 1


def words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z in lower case, and the text of the chunk it stands in."""
    begin, end = word_spans(chunk)
    value = hashes(_LOWER[chunk.data], begin, end)
    return value, np.searchsorted(chunk.ends, begin, side="right")


def shingle_sets(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending, and where each text's hashes end.

    A text of fewer than WIDTH words has one shingle, its whole sequence; one without words none.
    """
    word, text = words(chunk)
    n_words = np.bincount(text, minlength=len(chunk.ends))
    full = max(0, len(word) - WIDTH + 1)
    value = np.zeros(full, np.uint64)
    for k in range(WIDTH):
        value += word[k : k + full] * _PLACE[k]
    inside = text[:full] == text[WIDTH - 1 :] if full else np.zeros(0, bool)
    value, owner = mixed(value[inside]), text[:full][inside]
    short = np.flatnonzero((n_words > 0) & (n_words < WIDTH))
    if len(short):
        start = np.searchsorted(text, short)
        whole = n_words[short].astype(np.uint64)
        for k in range(WIDTH - 1):
            there = n_words[short] > k
            at = np.minimum(start + k, len(word) - 1)
            whole = whole + np.where(there, word[at] * _PLACE[k], np.uint64(0))
        value, owner = np.concatenate([value, mixed(whole)]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.cumsum(np.bincount(owner, minlength=len(chunk.ends)))


def set_ids(value: np.ndarray, ends: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One number for each set, from all its shingles in any order."""
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mixed(value + np.uint64(1)), out=sums[1:])
    return mixed(sums[ends] - sums[ends - n] + n.astype(np.uint64)).view(np.int64)
