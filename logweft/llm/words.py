"""Words of many documents at once, on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space as the contracts name it: blank and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Everything in ASCII that is neither a letter nor a digit.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C55
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as its bytes and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes, one row at least: first row, end row, bytes, offsets."""
    if not len(column):
        return
    data, offsets = flat(column)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(column), first + 65_535)
        own = offsets[first : end + 1]
        yield first, end, data[own[0] : own[-1]], own - own[0]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
    """Start and end byte of each word, and the number of the first word of each row (one more at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separator[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from running sums over all bytes."""
    global _powers, _inverses
    if len(_powers) < len(data) + 1:
        size = max(len(data) + 1, SLICE_BYTES + 1)
        steps = np.full(size, _MULTIPLIER, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
        steps[1:] = pow(_MULTIPLIER, -1, 1 << 64)
        _inverses = np.cumprod(steps)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * _inverses[starts])


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words; the last runs are shorter and belong to nobody."""
    total = np.zeros(len(words), np.uint64)
    factor = np.uint64(1)
    for shift in range(size):
        total[: max(len(words) - shift, 0)] += words[shift:] * factor
        factor = np.uint64((int(factor) * 0xC2B2AE3D27D4EB4F) % (1 << 64))
    return mix(total)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each pair, one after the other."""
    counts = counts.astype(np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(before - starts, counts)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Values as an Arrow column of lists with these lengths."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
