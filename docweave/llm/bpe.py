"""Byte-level BPE by corpus-level merge replay.

The new words of a block stand as one array of symbols. An inverted index leads from the token
that a pair makes to the positions of such pairs in all words, lowest rank first. Merges are
applied in that order, at once in all words where nothing of a lower rank waits, and only the
pairs with the two neighbours of a merged place enter the index anew. Words are merged together
but don't touch, so each gets what merging it alone would give: lowest rank first, leftmost of
equals first.

Defined results: null counts as empty; an empty text has no ids, and the digests are those of
the empty string; text that looks like a special token is ordinary text; of merges of one rank the leftmost
goes first; a null id stays null; rows that repeat an id or a text are each encoded; texts of any length
are encoded whole; an empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.columnar import blocks
from docweave.llm.segments import Arena, Segments, run_starts


def read_ranks(text: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line)}


class MergeReplay:
    """ranks: token bytes to id, of which every single byte is one."""

    #: With fewer unfinished words than this, the rest is replayed word by word.
    FEW = 128

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair makes, or -1; symbols below 0 make none."""
        if not len(self.keys):
            return np.full(len(left), -1)
        key = left << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], -1)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The index holds rank << 32 | position, sorted: for each token the places that make it.

        A round applies, for every word, the first entry of the index that lies in it, then
        drops the entries whose pair is gone and merges in those of the touched neighbours.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        start = np.concatenate(([0], np.cumsum(sizes + 1)))  # a symbol of -1 ends each word
        n = int(start[-1])
        word = np.repeat(np.arange(len(words)), sizes + 1)
        symbol = np.full(n, -1, np.int64)
        inner = np.ones(n, bool)
        inner[start[1:] - 1] = False
        symbol[inner] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        makes = np.append(self.ranks_of(symbol[:-1], symbol[1:]), -1) if n else np.zeros(0, np.int64)
        place = np.flatnonzero(makes >= 0)
        index = np.sort(makes[place] << 32 | place)
        first = np.zeros(len(words), np.int64)
        done = np.ones(len(words), bool)
        while len(index):
            place, rank = index & 0xFFFFFFFF, index >> 32
            own, turn = word[place], np.arange(len(index))
            first[own[::-1]] = turn[::-1]  # the last write stays: the earliest entry
            chosen = first[own] == turn
            if np.count_nonzero(chosen) < self.FEW:
                done[own] = False
                break
            i, r = place[chosen], rank[chosen]
            j = after[i]
            k = after[j]
            symbol[i], symbol[j] = r, -2
            after[i], before[k] = k, i
            p = before[i]
            at = np.concatenate((i, p[p >= 0]))
            found = self.ranks_of(symbol[at], symbol[after[at]])
            makes[j] = -1
            makes[at] = found
            at = at[found >= 0]
            kept = index[makes[place] == rank]
            kept = kept[~np.isin(kept & 0xFFFFFFFF, at, assume_unique=False)] if len(at) else kept
            index = np.concatenate((kept, np.sort(makes[at] << 32 | at)))
            index.sort(kind="stable")
        out: list = [None] * len(words)
        live = symbol[symbol != -2]
        ends = np.flatnonzero(live == -1)
        flat, lo = live.tolist(), 0
        for w, e in enumerate(ends.tolist()):
            out[w] = flat[lo:e]
            lo = e + 1
        for w in np.flatnonzero(~done).tolist():
            out[w] = self.replay_one(words[w])
        return out

    def replay_one(self, text: bytes) -> list[int]:
        """The same with a heap over the tokens in the index, for a single word of any length."""
        pairs = self.pairs
        symbol = [*self.byte[np.frombuffer(text, np.uint8)].tolist(), -1]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for i in range(n - 2):
            if (r := pairs.get(symbol[i] << 32 | symbol[i + 1])) is not None:
                index.setdefault(r, []).append(i)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for turn, i in enumerate(places):
                j = after[i] if symbol[i] >= 0 else n - 1
                if symbol[j] < 0 or pairs.get(symbol[i] << 32 | symbol[j]) != rank:
                    continue
                symbol[i], symbol[j] = rank, -2
                k = after[i] = after[j]
                before[k] = i
                lower = False
                for at in (before[i], i):
                    if at >= 0 and symbol[after[at]] >= 0 and (r := pairs.get(symbol[at] << 32 | symbol[after[at]])) is not None:
                        lower |= r < rank
                        if r in index:
                            index[r].append(at)
                        else:
                            index[r] = [at]
                            heapq.heappush(heap, r)
                if lower and turn + 1 < len(places):
                    # a lower rank has come up: it goes first, the other places wait
                    index.setdefault(rank, []).extend(places[turn + 1 :])
                    heapq.heappush(heap, rank)
                    break
        return [x for x in symbol[:-1] if x != -2]


class BpeCodec:
    """Whole texts to ids and back; ids of known segments are kept as the text of their digits, and decoded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay = MergeReplay(ranks)
        self.pattern = regex.compile(pattern)
        self.token = {v: k for k, v in ranks.items()}
        self.arena = Arena()
        self.digits: list[bytes] = []
        self.plain: list[bytes] = []
        self.segments = Segments(run_starts, self._encode)

    def _encode(self, segments: list[bytes], first: np.ndarray) -> np.ndarray:
        words: list[bytes] = []
        counts = []
        for s in segments:
            found = [m.encode() for m in self.pattern.findall(s.decode())]
            words += found
            counts.append(len(found))
        unique = list(dict.fromkeys(words))
        known = dict(zip(unique, self.replay.encode(unique), strict=True))
        it = iter(words)
        ids = [[x for _ in range(c) for x in known[next(it)]] for c in counts]
        self.digits += [",".join(map(str, x)).encode() for x in ids]
        self.plain += map(self.decode, ids)
        return self.arena.add(ids)

    def encode_block(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, bounds among them, the digits of each segment) of a block."""
        if self.arena.full():
            self.arena.clear()
            self.digits.clear()
            self.plain.clear()
            self.segments.forget()
        codes, bounds = self.segments.codes_of(data, offsets)
        ids, ends = self.arena.gather(codes, bounds)
        return ids, ends, codes, bounds

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_codecs: dict[tuple[str, str], BpeCodec] = {}


def codec(ranks_path: str, pattern: str) -> BpeCodec:
    """One codec for each worker process."""
    key = ranks_path, pattern
    if key not in _codecs:
        with open(ranks_path, "rb") as f:
            _codecs[key] = BpeCodec(read_ranks(f.read()), pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 for each document; with_ids adds the ids themselves.

    ranks_path is the tokenizer's file, installed alike on driver and executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                ids, ends, codes, bounds = own.encode_block(data, offsets)
                flat, seg = codes.tolist(), bounds.tolist()
                digits, plain = list(map(own.digits.__getitem__, flat)), list(map(own.plain.__getitem__, flat))
                joined = [hashlib.sha256(b",".join(filter(None, digits[s:e]))).hexdigest() for s, e in zip(seg, seg[1:], strict=False)]
                decoded = [hashlib.sha256(b"".join(plain[s:e])).hexdigest() for s, e in zip(seg, seg[1:], strict=False)]
                out = [batch.column(0).slice(a, b - a), pa.array(np.diff(ends), pa.int64()), pa.array(joined), pa.array(decoded)]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)
