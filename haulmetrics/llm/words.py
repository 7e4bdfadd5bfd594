"""Vectorised words and hashes over Arrow string columns, for use inside Spark tasks.

All functions work on the UTF-8 bytes of a slice of rows at a time, so memory follows the slice
(`CHUNK_BYTES`, or one document if that is longer), never the partition.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that belong to words: all but space and \t..\r; or digits, a-z (after lowering) and all non-ASCII.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[32, *range(9, 14)]] = False
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {b: np.ones(1, dtype=np.uint64) for b in (_BASE, _BASE_INVERSE)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """`n + 1` running sums from which `span_hashes` gets the hash of any byte range."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(_BASE, max(1, len(data)))[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes `[start, end)` of each range; equal bytes have equal hashes wherever they are."""
    inverse = powers(_BASE_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each position on."""
    n = len(sums) - size
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return mix((sums[size:] - sums[:-size]) * powers(_BASE_INVERSE, len(sums))[:n])


def slices(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """`(first row, end row, bytes, offsets)` of runs of rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1)
        yield first, end, data[offsets[first]: offsets[end]], offsets[first: end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in `data`, and per row the index of its first word (with an end mark)."""
    inside = word_bytes[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, with A-Z lowered, and per row the index of its first word (with an end mark)."""
    lowered = LOWER[data]
    starts, ends, bounds = word_spans(lowered, offsets, word_bytes)
    return span_hashes(prefix_sums(lowered), starts, ends), bounds


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All `start, start + 1, ...` of each length, one after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(np.asarray(starts, dtype=np.int64) - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift
