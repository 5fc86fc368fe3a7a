"""Word shingles, their sets and minwise signatures."""

from __future__ import annotations

import numpy as np

from docweave.llm.columnar import LOWER, chained, hashes, mix, windows, words

WIDTH = 5
#: Signatures have CHUNKS chunks of CHUNK symbols of 16 bits.
CHUNKS, CHUNK = 12, 5
SYMBOLS = CHUNKS * CHUNK

_rng = np.random.Generator(np.random.PCG64(4711))
_FACTOR = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERM = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_SALT = _rng.integers(0, 1 << 63, (CHUNKS, CHUNK), dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a block's texts, repeats included, and the texts' bounds among them."""
    data = LOWER[data]
    start, end, bounds = words(data, offsets)
    key = hashes(data, start, end)
    count = np.diff(bounds)
    short = (count > 0) & (count < WIDTH)
    at, _ = windows(bounds, WIDTH)
    ends = np.concatenate(([0], np.cumsum(np.maximum(count - WIDTH + 1, 0) + short)))
    out = np.empty(ends[-1], np.uint64)
    alone = ends[:-1][short]
    rest = np.ones(ends[-1], bool)
    rest[alone] = False
    whole = np.zeros(len(at), np.uint64)
    for k in range(WIDTH):
        whole = chained(whole, key[at + k])
    out[rest] = whole
    few, size = bounds[:-1][short], count[short]
    part = mix(size.astype(np.uint64))
    for k in range(WIDTH - 1):
        on = size > k
        part[on] = chained(part[on], key[few[on] + k])
    out[alone] = part
    return out, ends


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    all_of, ends = shingles(data, offsets)
    return [np.unique(all_of[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise signatures (texts, SYMBOLS) of 16 bits; of empty sets all 0."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    some = np.flatnonzero(sizes)
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
        for k in range(SYMBOLS):
            out[some, k] = (mix(np.minimum.reduceat(flat * _FACTOR[k] + _TERM[k], starts)) >> np.uint64(48)).astype(np.uint16)
    return out


def bucket_keys(signature: np.ndarray) -> np.ndarray:
    """For each chunk the keys of every choice of one symbol that may differ: two chunks share a key if at most one does."""
    chunks = signature.reshape(len(signature), CHUNKS, CHUNK).astype(np.uint64)
    keys = np.empty((len(signature), CHUNKS, CHUNK), np.uint64)
    for left_out in range(CHUNK):
        packed = np.zeros(chunks.shape[:2], np.uint64)
        for j in range(CHUNK):
            if j != left_out:
                packed = packed << np.uint64(16) | chunks[:, :, j]
        keys[:, :, left_out] = mix(packed ^ _SALT[:, left_out])
    return keys.reshape(len(signature), SYMBOLS)
