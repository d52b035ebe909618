"""Hashes of words and of five-word shingles, by numpy over an Arrow column's bytes at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text that are hashed at once; a longer text is hashed alone.
SLICE = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes and byte offsets (rows + 1, from 0) of runs of rows of about so many bytes or fewer; null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (a run without ASCII white space), and where each row's words begin (rows + 1)."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    ink = np.concatenate(([False], ~_WHITE[data], [False]))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(ink[1:-1] & (~ink[:-2] | edge[:-1]))
    ends = np.flatnonzero(ink[1:-1] & (~ink[2:] | edge[1:])) + 1
    bits = int(len(data)).bit_length()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, bits)[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * _powers(_INVERSE, bits)[starts]
    return mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each window of five words, and where each row's begin. A row of one to four words has one window, of them all."""
    counts = np.diff(begins)
    made = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(made)))
    first = np.arange(at[-1]) - np.repeat(at[:-1] - begins[:-1], made)
    ends = np.repeat(begins[1:], made)
    padded = np.concatenate((hashes, np.zeros(SHINGLE, np.uint64)))
    out = np.zeros(len(first), np.uint64)
    for k in range(SHINGLE):
        out += np.where(first + k < ends, padded[first + k] * _MUL[k], np.uint64(k))
    return mix(out), at
