"""Whole-column text work on Arrow buffers with numpy: words, lines and their hashes.

All functions see a block: the bytes of some consecutive texts and the offsets of each text.
Blocks are bounded, so memory doesn't grow with an Arrow batch; one text is never divided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C13)  # 3 modulo 4
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

#: The six bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept up to two blocks."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 12)
        have = np.full(1 << (size - 1).bit_length(), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 2 * BLOCK:
            _powers[int(base)] = have
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * base ** i, from which any range's hash follows."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges start..end, the same wherever equal values stand."""
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start])


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive texts; null is as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of inside bytes, cut where texts end; and each text's first run, with the count at last."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-text bounds of the words of a block."""
    return spans(~SPACE[data], offsets)


#: Ranges over so many bytes are hashed one by one.
LONG = 256
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_SIZE, _STEP = np.uint64(0xD1342543DE82EF95), np.uint64(0xA24BAED4963EE407)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, little-endian, with zeros after the end; index it, then view as u8."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "V8", padded, strides=(1,))


def lane(eight: np.ndarray, start: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight bytes from start, of which left are in the range, as integers."""
    return eight[start].view("<u8") & _MASK[np.minimum(left, 8)]


def chained(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Hashes of sequences that go on with value; no sum of values, so order and repeats don't cancel."""
    return mix(state * _STEP + value)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of a block: eight bytes at a time are mixed into a state, long ranges go to xxh3."""
    size = end - start
    out = mix(size.astype(np.uint64) * _SIZE)
    if not len(out):
        return out
    eight = lanes(data)
    out = chained(out, lane(eight, start, size))
    at, more = 8, np.flatnonzero((size > 8) & (size <= LONG))
    while len(more):
        out[more] = chained(out[more], lane(eight, start[more] + at, size[more] - at))
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]], seed=LONG)
    return out


def owner(bounds: np.ndarray) -> np.ndarray:
    """The text of each item, from the texts' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of each window of width items that lies in one text; and the texts' bounds among the windows."""
    counts = np.maximum(np.diff(bounds) - (width - 1), 0)
    out = np.concatenate(([0], np.cumsum(counts)))
    return np.repeat(bounds[:-1] - out[:-1], counts) + np.arange(out[-1]), out
