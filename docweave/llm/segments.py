"""Texts as codes of their segments, so that a tokenizer sees each new segment once.

A segment is white space and what follows it up to the next white space; no pattern or piece
used here reaches over its start, so a text's tokens are those of its segments, joined. Known
segments sit in a direct-mapped table by hash, with their bytes: memory is bounded whatever the
vocabulary, a segment that was pushed out is only tokenized again, and equal hashes don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from docweave.llm.columnar import SPACE, chained, lane, lanes, mix

SLOTS = 1 << 19
#: Segments of up to 8 * LANES bytes sit in slots; of longer ones at most HELD_MANY, of at most HELD_MAX bytes.
LANES, HELD_MANY, HELD_MAX = 3, 20_000, 1024

_SPLIT_SPACE = np.zeros(256, bool)
_SPLIT_SPACE[[0x20, 0x0A]] = True
#: Bytes before the last byte of a white space character outside ASCII; a segment isn't cut after such a pair.
_BEFORE = np.zeros(256, bool)
_BEFORE[[0xC2, 0x80, 0x81, 0x9A]] = True


def run_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cut before ASCII white space that follows a character that is none."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        white = SPACE[data] | ((data >= 0x1C) & (data <= 0x1F))
        before = data[:-1]
        wide = np.zeros(n - 1, bool)
        wide[1:] = (before[1:] >= 0x80) & _BEFORE[data[:-2]]
        cut[1:n] = SPACE[data[1:]] & ~white[:-1] & ~wide
    cut[offsets] = True
    return np.flatnonzero(cut[:n])


def space_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cut before each space and each newline."""
    cut = np.zeros(len(data) + 1, bool)
    cut[:-1] = _SPLIT_SPACE[data]
    cut[offsets] = True
    return np.flatnonzero(cut[: len(data)])


def run_of_spaces_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cut before each newline, and before each space that follows neither a space nor the mark that stands for one."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n:
        space = data == 0x20
        after = space.copy()
        after[2:] |= (data[2:] == 0x81) & (data[1:-1] == 0x96) & (data[:-2] == 0xE2)
        cut[:n] = data == 0x0A
        cut[1:n] |= space[1:] & ~after[:-1]
    cut[offsets] = True
    return np.flatnonzero(cut[:n])


class Segments:
    """encode takes new segments (bytes, and whether each begins a text) and returns their codes.

    A slot holds the bytes of its segment, so a code is only given to equal bytes; segments that
    are longer than a slot are looked up by their bytes, and those beyond HELD_MAX aren't kept.
    """

    def __init__(self, starts: Callable, encode: Callable[[list[bytes], np.ndarray], np.ndarray], first_differs: bool = False):
        self.starts, self.encode, self.first_differs = starts, encode, first_differs
        self.forget()

    def forget(self) -> None:
        self.held = np.zeros((SLOTS, LANES + 1), np.uint64)  # size and first mark, then the bytes
        self.codes = np.zeros(SLOTS, np.int64)
        self.long: dict[tuple[bytes, bool], int] = {}

    def codes_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of each segment of a block, and the texts' bounds among them."""
        start = self.starts(data, offsets)
        bounds = np.searchsorted(start, offsets)
        if not len(start):
            return np.zeros(0, np.int64), bounds
        end = np.append(start[1:], len(data))
        size = end - start
        first = np.zeros(len(start), bool)
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        marked = first & self.first_differs
        out = np.empty(len(start), np.int64)

        short = np.flatnonzero(size <= 8 * LANES)
        eight = lanes(data)
        own = np.empty((len(short), LANES + 1), np.uint64)
        own[:, 0] = size[short].astype(np.uint64) << np.uint64(1) | marked[short]
        key = mix(own[:, 0] + np.uint64(1))
        for k in range(LANES):
            left = np.maximum(size[short] - 8 * k, 0)
            own[:, k + 1] = lane(eight, np.minimum(start[short] + 8 * k, len(data)), left)
            key = chained(key, own[:, k + 1])
        slot = (key & np.uint64(SLOTS - 1)).astype(np.int64)
        missed = np.flatnonzero((self.held[slot] != own).any(axis=1))
        out[short] = self.codes[slot]

        fresh, at, back = np.unique(key[missed], return_index=True, return_inverse=True)
        same = (own[missed] == own[missed[at]][back]).all(axis=1)  # False only where hashes of two segments are equal
        once = np.concatenate((missed[at], missed[~same]))
        long = np.flatnonzero(size > 8 * LANES)
        raw = data.tobytes()
        by_bytes = [(raw[a:b], m) for a, b, m in zip(start[long].tolist(), end[long].tolist(), marked[long].tolist(), strict=True)]
        unknown = {x: None for x in by_bytes if x not in self.long}
        of_once = short[once]
        segments = [raw[a:b] for a, b in zip(start[of_once].tolist(), end[of_once].tolist(), strict=True)] + [x for x, _ in unknown]
        if segments:
            marks = np.concatenate((marked[of_once] if self.first_differs else first[of_once], np.fromiter((m for _, m in unknown), bool, len(unknown))))
            codes = self.encode(segments, marks)
            of_fresh = codes[: len(fresh)]
            out[short[missed]] = of_fresh[back]
            out[short[missed[~same]]] = codes[len(fresh) : len(once)]
            slot = slot[missed[at]]
            self.codes[slot], self.held[slot] = of_fresh, own[missed[at]]
            # of several fresh segments for a slot numpy keeps the last for both arrays alike
            new = dict(zip(unknown, codes[len(once) :].tolist(), strict=True))
        else:
            new = {}
        out[long] = [new[x] if x in new else self.long[x] for x in by_bytes]
        if new:
            if len(self.long) + len(new) > HELD_MANY:
                self.long.clear()
            self.long.update((x, c) for x, c in new.items() if len(x[0]) <= HELD_MAX)
        return out, bounds


class Arena:
    """Token ids of the segments that were encoded; codes are indexes into it."""

    LIMIT = 6_000_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.tokens = [], [], 0
        self._flat: tuple | None = None

    def add(self, id_lists: list) -> np.ndarray:
        first = len(self.lengths)
        lengths = list(map(len, id_lists))
        self.ids.append(np.fromiter((x for ids in id_lists for x in ids), np.int32, sum(lengths)))
        self.lengths += lengths
        self.tokens += len(self.ids[-1])
        self._flat = None
        return np.arange(first, len(self.lengths))

    def full(self) -> bool:
        return self.tokens > self.LIMIT

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._flat is None:
            ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32)
            self.ids = [ids]
            lengths = np.array(self.lengths, np.int64)
            self._flat = ids, np.concatenate(([0], np.cumsum(lengths))), lengths
        return self._flat

    def gather(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's segments, and the texts' bounds among them."""
        ids, starts, lengths = self.flat()
        counts = lengths[codes]
        ends = np.concatenate(([0], np.cumsum(counts)))
        where = np.repeat(starts[codes] - ends[:-1], counts) + np.arange(ends[-1])
        return ids[where], ends[bounds]
