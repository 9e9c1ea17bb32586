"""Vectorised word and shingle hashes over Arrow text columns.

Texts are hashed where they lie in the Arrow buffer, in slices of a bounded number of bytes, so memory
does not follow the batch. A word's hash is a sum over its bytes of (random value of the byte) times (odd
random value of its place), then mixed; a shingle's is the same over its words.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE = 5


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def noise(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed))


SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
VALUE = noise(1, 256)
VALUE[65:91] = VALUE[97:123]  # A-Z as a-z
VALUE[SPACE] = 0
PLACES = [noise(2, 4096) | np.uint64(1)]
IN_SHINGLE = noise(3, SHINGLE) | np.uint64(1)
SHORT = noise(4, SHINGLE)


def places(n: int) -> np.ndarray:
    if len(PLACES[0]) < n:
        PLACES[0] = noise(2, 2 * n) | np.uint64(1)
    return PLACES[0]


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column number `text` holds about `limit` bytes, or one row, in each."""
    for batch in batches:
        ends = offsets(batch.column(text))[1:]
        at = 0
        while at < batch.num_rows:
            start = ends[at - 1] if at else offsets(batch.column(text))[0]
            upto = max(at + 1, int(np.searchsorted(ends, start + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` that gives its freed memory back to the system at its end, since Spark keeps Python workers for later tasks."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return whole


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of the values in the column's buffer."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its values in them; a null is empty."""
    off = offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, cut at ASCII white space) and the offsets of each text in them."""
    data, off = utf8(column)
    n = len(off) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    space = SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    start[first] = ~space[first]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    at = np.arange(len(data)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(starts, append=len(data)))])
    value = VALUE[data]
    value *= places(int(at.max()) + 1)[at]
    return mixed(np.add.reduceat(value, starts)), np.searchsorted(starts, off).astype(np.int64)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text its sorted distinct 5-word shingles; with fewer words one of all of them, without any none."""
    words, off = word_hashes(column)
    if len(words) >= SHINGLE:
        n = len(words) - SHINGLE + 1
        total = words[:n] * IN_SHINGLE[0]
        for k in range(1, SHINGLE):
            total += words[k : k + n] * IN_SHINGLE[k]
        total = mixed(total)
    for a, b in zip(off[:-1], off[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(total[a : b - SHINGLE + 1])
        elif b > a:
            yield mixed(np.append(words[a:b] * IN_SHINGLE[: b - a], SHORT[b - a]).sum(dtype=np.uint64, keepdims=True))
        else:
            yield np.zeros(0, np.uint64)
