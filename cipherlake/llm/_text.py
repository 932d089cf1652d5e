"""Byte-level kernels shared by the text operators.

Texts stay in Arrow's buffers: a batch is one byte array with offsets, and words, lines and
their hashes come from whole-array numpy operations, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space of the contracts: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.RandomState(20).randint(1, 2**62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.ones(1, np.uint64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets (one more than rows). Null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text each; a longer text is a piece of its own."""
    offsets, start = buffers(batch.column(name))[1], 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true within each text: starts, ends, and the text's index."""
    size = mask.size
    if size == 0:
        return (np.zeros(0, np.int64),) * 3
    before, after = np.zeros(size, bool), np.zeros(size, bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    before[offsets[:-1][offsets[:-1] < size]] = False
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(mask & ~before)
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(count: int) -> np.ndarray:
    global _POWERS
    if _POWERS.size < count:
        more = np.full(max(count, 1024), _BASE, np.uint64)
        more[0] = 1
        _POWERS = np.cumprod(more, dtype=np.uint64)
    return _POWERS


def spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of positive length: every index, its place within the run, and where each run begins in these."""
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    return np.repeat(starts, lengths) + place, place, first


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty byte run."""
    if starts.size == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    index, place, first = spread(starts, lengths)
    value = _BYTE[data[index]] * powers(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a per-byte array over each text."""
    total = np.zeros(values.size + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs more than once, and whether it is a later occurrence."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice, later = np.zeros(keys.size, bool), np.zeros(keys.size, bool)
    twice[order[1:]] |= same
    later[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later
