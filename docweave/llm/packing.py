"""Packing by shortest-pack-first over the length histogram.

Documents are tokenized, ended by one id and cut into full sequences and a remainder. The
histogram of piece lengths (at most one line for each length) goes to the driver, where lengths
are placed longest first, each into the shortest pack that there is; packs of one pattern are
moved together, so the work depends on the lengths, not on the documents. The patterns come back
to the pieces by rank: the r-th piece of a length takes the r-th place that patterns have for
that length. Ranks come from counts per input partition, so no length's pieces meet in one task.

Defined results: null text counts as empty and is the end id alone; a null id stays null; rows that
repeat an id are packed each for itself; pieces of equal length go in the order of input partitions and rows;
texts of any length are cut, never shortened; an empty table gives no pieces; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docweave.llm.columnar import blocks
from docweave.llm.segments import Arena, Segments, run_starts
from docweave.llm.storage import materialise


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class SegmentTokenizer:
    """The ids that a byte-level tokenizers file gives, each new segment encoded once.

    Where ids are in merge order, a faster library encodes by the file's own vocabulary;
    segments that hold an added token, and files of other orders, go to tokenizers itself.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        self.exact = Tokenizer.from_file(path)
        self.added = [t["content"] for t in raw["added_tokens"]]
        alphabet = byte_alphabet()
        added = set(self.added)
        ranks = {bytes(alphabet[c] for c in token): i for token, i in raw["model"]["vocab"].items() if token not in added}
        merged = [ranks[bytes(alphabet[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in raw["model"]["merges"]]
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if merged == sorted(merged) else None
        self.arena = Arena()
        self.segments = Segments(run_starts, self._encode)

    def _encode(self, segments: list[bytes], first: np.ndarray) -> np.ndarray:
        texts = [s.decode() for s in segments]
        if self.fast is None:
            return self.arena.add([e.ids for e in self.exact.encode_batch(texts, add_special_tokens=False)])
        encode = self.fast.encode_ordinary
        return self.arena.add([self.exact.encode(t, add_special_tokens=False).ids if any(x in t for x in self.added) else encode(t) for t in texts])

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.arena.full():
            self.arena.clear()
            self.segments.forget()
        return self.arena.gather(*self.segments.codes_of(data, offsets))


_tokenizers: dict[tuple[str, str], SegmentTokenizer] = {}


def segment_tokenizer(path: str, pattern: str) -> SegmentTokenizer:
    """One for each worker process."""
    if (path, pattern) not in _tokenizers:
        _tokenizers[path, pattern] = SegmentTokenizer(path, pattern)
    return _tokenizers[path, pattern]


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(packs, pattern of lengths) that hold all pieces; no pattern is longer than size."""
    by_space: dict[int, list[list]] = {}
    spaces: list[int] = []  # ascending, of those in by_space

    def put(space: int, packs: int, pattern: tuple[int, ...]) -> None:
        if space not in by_space:
            by_space[space] = []
            spaces.insert(bisect_left(spaces, space), space)
        by_space[space].append([packs, pattern])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not spaces or spaces[-1] < length:
                # a new pack is the shortest that fits, so pieces of this length go on into it
                each = size // length
                full, rest = divmod(left, each)
                if full:
                    put(size - each * length, full, (length,) * each)
                if rest:
                    put(size - rest * length, 1, (length,) * rest)
                break
            space = spaces[-1]
            group = by_space[space][-1]
            packs = min(left, group[0])
            group[0] -= packs
            if not group[0]:
                by_space[space].pop()
                if not by_space[space]:
                    del by_space[space]
                    spaces.pop()
            put(space - length, packs, (*group[1], length))
            left -= packs
    return [(packs, pattern) for space in spaces for packs, pattern in by_space[space]]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, ...]:
    """Runs of places in order: (length, first rank), the first sequence, packs, the first offset.

    A run is all places that the packs of a pattern have for a length: rank by rank through the
    packs, then through the places of the length in each. There are at most 2 * size patterns,
    since placing a length splits no more than one and opens no more than two, and lengths that
    differ and fit in one are fewer than 64 for a size of 2048: so at most 262,144 runs, 8 MB.
    """
    base, taken, runs = 0, {}, []
    for packs, pattern in patterns:
        offset = 0
        for length, n in Counter(pattern).items():
            rank = taken.get(length, 0)
            runs.append((length << 44 | rank, base, packs, offset))
            taken[length] = rank + packs * n
            offset += length * n
        base += packs
    return tuple(np.array(sorted(runs), np.int64).reshape(-1, 4).T.copy())


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer_path: str, pattern: str, size: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of at most size ids, with the input partition and the rank there among pieces of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segment_tokenizer(tokenizer_path, pattern)
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                ids, ends = own.encode_block(data, offsets)
                docs_here = b - a
                total = np.diff(ends) + 1
                flat = np.empty(len(ids) + docs_here, "<u4")
                flat[np.arange(len(ids)) + np.repeat(np.arange(docs_here), total - 1)] = ids
                stop = ends[1:] + np.arange(1, docs_here + 1)
                flat[stop - 1] = end_id
                pieces = -(-total // size)
                doc = np.repeat(np.arange(docs_here), pieces)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * size
                length = np.minimum(total[doc] - start, size)
                at = (stop - total)[doc] + start
                view = memoryview(flat).cast("B")
                crc = [zlib.crc32(view[4 * s : 4 * (s + n)]) for s, n in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                lengths, first, counts = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.repeat(first, counts) + np.repeat(seen[lengths], counts)
                seen[lengths] += counts
                out = [batch.column(0).slice(a, docs_here).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[doc]), pa.array(np.full(len(doc), part, np.int64)), pa.array(rank)]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"{PIECES}, part long, rank long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids."""
    spark = docs.sparkSession
    pieces = materialise(cut_documents(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), tokenizer_path, pattern, size, end_id, with_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    table = spark.sparkContext.broadcast(places(shortest_pack_first(histogram, size)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, packs, offset = table.value
        for batch in batches:
            length = np.asarray(batch.column("length"))
            want = length << 44 | np.asarray(batch.column("rank"))
            run = np.searchsorted(key, want, "right") - 1
            turn, pack = np.divmod(want - key[run], packs[run]) if len(want) else (want, want)
            out = [batch.column(c) for c in kept] + [pa.array(first[run] + pack), pa.array(offset[run] + turn * length)]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "sequence_id", "offset"])

    kept = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
    ranked = pieces.join(counts.select("part", "length", "before"), ["part", "length"]).select(*kept, (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, PIECES + ", ids array<int>" * with_ids + ", sequence_id long, offset long")
