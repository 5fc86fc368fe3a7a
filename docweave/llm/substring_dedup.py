"""Substring dedup by relative Lempel-Ziv parsing over word blocks.

A document is factored against the reference blocks (WINDOW consecutive words) of all documents
with smaller ids. The reference index holds each block by a cryptographic digest of its text, with
the first document and the place that it starts at. The parse goes from left to right: where the
block at a word is indexed, a factor (start, length, reference document, place there) begins, and
it grows by a word as long as the next block is the next one of the same reference; other words
are literals. At the end of a factor the block that lies across the boundary is looked up as every
other, so a copy that goes on in another reference is a factor of its own and none is missed.
Factors, which have WINDOW words at least, are the duplicate spans.

Most blocks never get into the index. Each block has an anchor, the least hash of its word
sequences of ANCHOR words, which equal blocks share; only anchors that two documents have can
mark a copy, and only blocks under them are exchanged. Documents of equal words are settled before:
all but the first are one factor.

Defined results: null text has no words; a null id matches nothing; rows that repeat an id don't
cover each other; texts under WINDOW words stay whole; texts of any length are parsed whole; an
empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.columnar import blocks, hashes, mix, prefix_sums, range_hash, windows, words
from docweave.llm.exact_dedup import tree_merge
from docweave.llm.storage import materialise, materialise_counted, skew_join, split_join

WINDOW, ANCHOR = 50, 24


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


class Parsed:
    """Words and block anchors of the texts of an Arrow block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
        self.raw = data.tobytes()
        self.start, self.end, self.bounds = words(data, offsets)
        key = hashes(data, self.start, self.end)
        at, self.ends = windows(self.bounds, window)
        if len(at):
            grams = range_hash(prefix_sums(mix(key ^ np.uint64(0xA0761D6478BD642F))), np.arange(len(key) - anchor + 1), np.arange(anchor, len(key) + 1))
            self.anchor = sliding_min(grams, window - anchor + 1)[at]
        else:
            self.anchor = np.zeros(0, np.uint64)

    def blocks_of(self, i: int) -> slice:
        return slice(self.ends[i], self.ends[i + 1])

    def text(self, i: int, kept: np.ndarray | None = None) -> bytes:
        """A text's words, or those kept, joined by one space."""
        s, e = self.start[self.bounds[i] : self.bounds[i + 1]], self.end[self.bounds[i] : self.bounds[i + 1]]
        if kept is not None:
            s, e = s[kept], e[kept]
        return b" ".join([self.raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)])

    def digests(self, i: int, at: np.ndarray, window: int = WINDOW) -> list[bytes]:
        """Digests of the text of the blocks that start at the given words of a text."""
        if not len(at):
            return []
        size = (self.end - self.start)[self.bounds[i] : self.bounds[i + 1]] + 1
        edge = np.concatenate(([0], np.cumsum(size)))
        text = self.text(i)
        return [hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(edge[at].tolist(), (edge[at + window] - 1).tolist(), strict=True)]


def factors(at: np.ndarray, ref: np.ndarray, ref_at: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(start, length, reference, place there) of the factors of a parse, from the indexed blocks of a text in order."""
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(ref) != 0) | (np.diff(ref_at) != 1)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])) - 1
    return list(zip(at[first].tolist(), (at[last] - at[first] + window).tolist(), ref[first].tolist(), ref_at[first].tolist(), strict=True))


def profiles(docs: DataFrame) -> DataFrame:
    """(id, n_words, words_sha, anchors): anchors without near repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                own = Parsed(data, offsets)
                sha = [hashlib.sha256(own.text(i)).digest() for i in range(b - a)]
                new = np.ones(len(own.anchor), bool)
                new[1:] = own.anchor[1:] != own.anchor[:-1]
                new[own.ends[:-1][np.diff(own.ends) > 0]] = True
                ends = np.concatenate(([0], np.cumsum(new)))[own.ends]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own.anchor[new].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(own.bounds), pa.int64()), pa.array(sha, pa.binary()), lists], names=["id", "n_words", "words_sha", "anchors"])

    return docs.mapInArrow(run, "id long, n_words long, words_sha binary, anchors array<long>")


def reference_blocks(docs: DataFrame) -> DataFrame:
    """(id, mark, at, block) of the blocks of (id, text, anchors) that lie under one of the anchors: first word and digest.

    mark tells apart the texts of an id that stands in several rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shared = batch.column(0).to_numpy(), batch.column(2)
            for a, b, data, offsets in blocks(batch.column(1)):
                own = Parsed(data, offsets)
                doc, mark, at, block = [], [], [], []
                for i in range(b - a):
                    under = np.flatnonzero(np.isin(own.anchor[own.blocks_of(i)], np.asarray(shared[a + i].values).view(np.uint64)))
                    doc.append(np.full(len(under), ids[a + i]))
                    mark.append(np.full(len(under), mark_of(hashlib.sha256(own.text(i)).digest())))
                    at.append(under)
                    block += own.digests(i, under)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(doc)), pa.array(np.concatenate(mark), pa.int64()), pa.array(np.concatenate(at), pa.int32()), pa.array(block, pa.binary())], names=["id", "mark", "at", "block"])

    return docs.mapInArrow(run, "id long, mark long, at int, block binary")


def mark_of(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little", signed=True)


FACTORS = "array<struct<start: long, length: long, ref_id: long, ref_start: long>>"
_FACTORS = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "ref_id", "ref_start")]))


def parsed(docs: DataFrame) -> DataFrame:
    """(id, words_sha, n_removed, kept_text, factors) of (id, text, found, mark), where found are the indexed blocks (at, ref, ref_at) of the text of that mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, marks = batch.column(2), batch.column(3).to_pylist()
            for a, b, data, offsets in blocks(batch.column(1)):
                own = Parsed(data, offsets)
                sha, removed, texts, parses, mine = [], [], [], [], []
                for i in range(b - a):
                    digest = hashlib.sha256(own.text(i)).digest()
                    if mark_of(digest) != marks[a + i]:
                        continue
                    mine.append(a + i)
                    at, ref, ref_at = (np.asarray(x) for x in found[a + i].values.flatten())
                    order = np.argsort(at)
                    parse = factors(at[order], ref[order], ref_at[order])
                    kept = np.ones(own.bounds[i + 1] - own.bounds[i], bool)
                    for first, length, _, _ in parse:
                        kept[first : first + length] = False
                    sha.append(digest)
                    removed.append(len(kept) - int(kept.sum()))
                    texts.append(own.text(i, kept).decode())
                    parses.append([dict(zip(("start", "length", "ref_id", "ref_start"), x, strict=True)) for x in parse])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(mine, pa.int64())), pa.array(sha, pa.binary()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), pa.array(parses, _FACTORS)], names=["id", "words_sha", "n_removed", "kept_text", "factors"])

    return docs.mapInArrow(run, f"id long, words_sha binary, n_removed long, kept_text string, factors {FACTORS}")


def indexed_blocks(texts: DataFrame, profile: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(id, mark, found), the indexed blocks of each text, and (id, words_sha, keep_id) of texts all of whose words go."""
    whole = profile.where(f"n_words >= {WINDOW} AND id IS NOT NULL")
    first = tree_merge(whole.select("id", F.col("words_sha").alias("key")), "min", name="word-runs")
    copies = skew_join(whole.select("id", F.col("words_sha").alias("key")), first.where("group_size > n_keep").select("key", "keep_id", "group_size"), "key", F.col("group_size"), total)
    copies = materialise(copies.where("id > keep_id").select("id", F.col("key").alias("words_sha"), "keep_id").distinct(), "word-copies")
    leading = whole.join(copies, ["id", "words_sha"], "left_anti")
    anchors = leading.select("id", "words_sha", F.explode(F.array_distinct("anchors")).alias("anchor"))
    shared, seen = materialise_counted(anchors.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low < high").select("anchor", "n"), "anchors", F.sum("n").alias("rows"))
    mine = split_join(anchors, shared, "anchor", F.col("n"), seen.rows or 1).groupBy("id", "words_sha").agg(F.collect_set("anchor").alias("anchors"))
    mine = mine.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("anchors"))).alias("anchors"))
    candidates, met = materialise_counted(reference_blocks(texts.join(mine, "id").select("id", "text", "anchors")), "blocks")
    index = candidates.groupBy("block").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n"), F.max("id").alias("last")).where("first.id < last")
    index = index.select("block", F.col("first.id").alias("ref"), F.col("first.at").cast("long").alias("ref_at"), "n")
    later = split_join(candidates, materialise(index, "index"), "block", F.col("n"), max(met.n, 1)).where("id > ref")
    return later.groupBy("id", "mark").agg(F.collect_set(F.struct(F.col("at").cast("long").alias("at"), "ref", "ref_at")).alias("found")), copies


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, with_factors: bool = False) -> DataFrame:
    """One row for each document: id, n_words, n_removed, kept_sha256; with_text adds the kept words where some were removed, with_factors the spans."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    profile, seen = materialise_counted(profiles(texts), "profiles")
    found, copies = indexed_blocks(texts, profile, max(seen.n, 1))
    cut = parsed(texts.join(found, "id").select("id", "text", "found", "mark")).select("id", "words_sha", "n_removed", F.sha2("kept_text", 256).alias("sha"), *["kept_text"] * with_text, *["factors"] * with_factors).dropDuplicates(["id", "words_sha"])
    out = profile.select("id", "n_words", "words_sha").join(copies, ["id", "words_sha"], "left").join(cut, ["id", "words_sha"], "left")
    hit = F.col("keep_id").isNotNull()
    columns = [
        F.col("id").alias(id_col),
        "n_words",
        F.when(hit, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(hit, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", F.lower(F.hex("words_sha")))).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(hit, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    if with_factors:
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("length"), F.col("keep_id").alias("ref_id"), F.lit(0).cast("long").alias("ref_start")))
        columns.append(F.when(hit, whole).otherwise(F.coalesce("factors", F.array().cast(FACTORS))).alias("factors"))
    return out.select(*columns)
