"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and bytes outside ASCII, A-Z lower-cased. A text's features are
the distinct hashes of its words, word pairs, and pairs with one word between. FTRL-proximal
with a rate for each coordinate and an L1 term leaves few weights that aren't 0; those are
broadcast, at most 2 ** BITS numbers. A text's score depends on its words only.

Training sees a bounded sample of labelled rows outside the held-out fold: the first 2 * SAMPLE of
both labels together in the order of a hash of the id, as far as they have SLOTS slots that count, so
that each label has its natural share and the threshold means the same at every size. Scores cover all documents and whole texts.

Defined results: null counts as empty; an empty text gets the score of the intercept alone;
labels that are null or contradict each other for an id are not learnt; with no labels to learn
from, every score is 0; with labels of one kind only, the intercept carries them; rows that repeat an id are each
scored, and learnt with the id's label; a null id is scored and not held out; texts of any length
are scored whole; an empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.columnar import LOWER, blocks, hashes, mix, owner, spans, windows
from docweave.llm.quality import agreed
from docweave.llm.storage import materialise, materialise_counted

BITS = 20
#: Half of the labelled rows that training sees at most; and the slots of theirs, 64 MB, after which no more rows are taken.
SAMPLE, SLOTS = 6_000, 16_000_000
THRESHOLD = 0.3

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_PAIR, _SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A3564E27F8862F)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every n-gram and skip-gram of a block, repeats included."""
    data = LOWER[data]
    start, end, bounds = spans(_INSIDE[data], offsets)
    key = hashes(data, start, end)
    text = owner(bounds)
    two, _ = windows(bounds, 2)
    three, _ = windows(bounds, 3)
    found = np.concatenate((key, mix(key[two] * _PAIR + key[two + 1]), mix(key[three] * _SKIP + key[three + 2])))
    return np.concatenate((text, text[two], text[three])), (found >> np.uint64(64 - BITS)).astype(np.int64)


def distinct(text: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(text << BITS | slot)
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Ftrl:
    """FTRL-proximal: state z and n, weights follow from them and are 0 within the L1 term."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.0

    def __post_init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last is the intercept

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, label: int, weight: float = 1.0) -> None:
        at = np.append(slots, 1 << BITS)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def model(self) -> np.ndarray:
        return self.weights(np.arange((1 << BITS) + 1)).astype(np.float64)


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 3, seed: int = 3, **rates: float) -> np.ndarray | None:
    """Weights from rows of distinct slots."""
    if not len(labels):
        return None
    model, rng = Ftrl(**rates), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(labels)).tolist():
            model.learn(rows[i], int(labels[i]))
    return model.model()


def scores(weights: np.ndarray | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if weights is None:
        return np.zeros(len(offsets) - 1)
    text, slot = features(data, offsets)
    some = weights[slot] != 0
    text, slot = distinct(text[some], slot[some])
    total = np.bincount(text, weights[slot], len(offsets) - 1) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", epochs: int = 3) -> np.ndarray | None:
    """Weights from the bounded sample; the fold of remainder 2 is never looked at.

    Slots that too few rows of the sample have are left out: a row moves a coordinate by less
    than 1 an epoch, so they can't leave the L1 term and the model is the same without them.
    """
    seen = agreed(labels.where(fold(id_col) != 2), "toxic", id_col).where("label IN (0, 1)")
    sample = seen.orderBy(F.xxhash64("id"), "id").limit(2 * SAMPLE).select("id", F.col("label").cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                text, slot = distinct(*features(data, offsets))
                slots = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(b - a + 1)), pa.int32()), pa.array(slot, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a), slots], names=["id", "label", "digest", "slots"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "text", "label", F.xxhash64("text").alias("digest"))
    # an id counts once, by its text of the least hash, so that what comes to the driver is bounded by ids, not by rows
    mapped = chosen.mapInArrow(run, "id long, label int, digest long, slots array<int>")
    one = mapped.groupBy("id", "label").agg(F.min_by("slots", F.struct("digest", F.size("slots"))).alias("slots"))
    rows, n = materialise_counted(one, "labelled-slots")
    if not n.n:
        return None
    least = int(Ftrl.l1 / epochs) + 1
    often = rows.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("slot")
    kept = np.zeros(1 << BITS, bool)
    kept[np.asarray(often.toArrow().column("slot"))] = True  # at most 2 ** BITS of them
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(kept))

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            slots = [s[some[s]] for s in (np.asarray(x.values) for x in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, slots)), pa.int64()), pa.array(slots, pa.list_(pa.int32()))], names=["id", "label", "n", "slots"])

    lean = materialise(rows.mapInArrow(pruned, "id long, label int, n long, slots array<int>").withColumn("turn", F.xxhash64("id")), "lean-slots")
    sizes = lean.select("turn", "n").toArrow().sort_by("turn")  # at most 2 * SAMPLE rows
    turns, total = np.asarray(sizes.column("turn")), np.cumsum(np.asarray(sizes.column("n")))
    last = int(turns[max(int(np.searchsorted(total, SLOTS, "right")) - 1, 0)])
    table = lean.where(F.col("turn") <= last).select("id", "label", "slots").toArrow().combine_chunks().sort_by([("id", "ascending"), ("label", "ascending")])
    slots = table.column("slots").combine_chunks()
    flat, ends = np.asarray(slots.flatten()), np.asarray(slots.offsets)
    return train([flat[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:], strict=False)], np.asarray(table.column("label")), epochs)


def score_toxicity(docs: DataFrame, weights: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score, predicted for each document."""
    sparse = None if weights is None else (np.flatnonzero(weights), weights[np.flatnonzero(weights)])
    shared = docs.sparkSession.sparkContext.broadcast(sparse)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        if shared.value is not None:
            own = np.zeros((1 << BITS) + 1)
            own[shared.value[0]] = shared.value[1]
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores(own, data, offsets))], names=[id_col, "score"])

    scored = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"{id_col} long, score double")
    return scored.select(id_col, F.coalesce(fold(id_col) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score_toxicity(docs, learn_toxicity(docs, labels, id_col, text_col), id_col, text_col)
