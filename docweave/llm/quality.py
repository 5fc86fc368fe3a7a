"""Quality rules: statistics of each text, and an isolation forest over them.

The base rule rejects texts of too few words or with too many repeated ones. The forest is
grown on rule statistics of one half of the labelled rows that pass it; a document that random splits isolate
from the good ones after short paths is anomalous. The threshold on its score is set on the other half,
rows of both kinds: of those that lose at most MAX_LOSS of the good rows, the one with the least
sum of lost good and kept bad shares.

All labelled rows take part, at every size: each tree draws its own TREE_ROWS rows, as the method has it, out of all
of the one half by a hash of tree and id, and the threshold is found by running counts over the scores of all of the
other. Statistics of all documents are joined to labels by id, without texts; what comes to the driver is trees
and a line for each of BINS ranges of the score.

Defined results: null counts as a text without words; without labelled rows of both kinds the
base rule alone decides; where a half lacks a kind, all rows serve both ends; of thresholds of equal cost
the highest is taken, and a score at the threshold is kept; labels that are null or contradict each other
for an id are not used; rows that repeat an id are each judged; a null id is judged and never learnt; texts
of any length are measured whole; an empty table gives no rows; other columns, whatever their names, are left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.columnar import blocks, hashes, mix, owner, spans, windows, words
from docweave.llm.storage import materialise, materialise_counted

MAX_LOSS = 0.01
TREES, TREE_ROWS, DEEPEST = 200, 256, 12
#: Ranges of the score whose counts come to the driver.
BINS = 1 << 14
SEED = 7

_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_PUNCT = np.zeros(256, np.int64)
_PUNCT[list(b"!?\"'()[]{};:,.-_/\\+=~^@`")] = 1
_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:] = 1

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "punctuation", "letters", "line_words", "distinct_words")


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def equal_before(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key stands earlier too, and whether it stands twice or more."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    before, twice = np.empty(len(keys), bool), np.empty(len(keys), bool)
    before[order], twice[order] = same[:-1], same[:-1] | same[1:]
    return before, twice


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base statistics of a block's texts, and the ratios that the forest sees."""
    n = len(offsets) - 1
    start, end, bounds = words(data, offsets)
    n_words = np.diff(bounds)
    key = hashes(data, start, end)
    text = owner(bounds)
    salt = mix(text.astype(np.uint64) + np.uint64(1))

    point = ((data & 0xC0) != 0x80).astype(np.int64)
    chars = np.concatenate(([0], np.cumsum(point)))
    word_chars = np.diff(np.concatenate(([0], np.cumsum(chars[end] - chars[start])))[bounds])

    line_start, line_end, line_bounds = spans(data != 0x0A, offsets)
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_text = line_start[has_word], line_end[has_word], owner(line_bounds)[has_word]
    lines = np.bincount(line_text, minlength=n)
    dup, _ = equal_before(hashes(data, line_start, line_end) ^ mix(line_text.astype(np.uint64) + np.uint64(1)))
    dup_lines = np.bincount(line_text[dup], minlength=n)

    at, _ = windows(bounds, 3)
    triple = mix(key[at] + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(3) + mix(key[at + 1] + np.uint64(0x7F4A7C15)) * np.uint64(5) + mix(key[at + 2])
    _, twice = equal_before(mix(triple) ^ salt[at])
    repeated = np.zeros(len(key), bool)
    for k in range(3):
        repeated[at[twice] + k] = True
    repeat_words = np.diff(np.concatenate(([0], np.cumsum(repeated)))[bounds])

    before, _ = equal_before(key ^ salt)
    distinct = n_words - np.bincount(text[before], minlength=n)

    size = np.maximum(np.diff(chars[offsets]), 1)
    letters = per_text(_LETTER[data], offsets)
    symbols = per_text(_SYMBOLS[data], offsets)
    some = np.maximum(n_words, 1)
    base = dict(zip(BASE, (n_words, word_chars, symbols, dup_lines, repeat_words), strict=True))
    ratios = np.stack(
        [
            word_chars / some,
            symbols / some,
            dup_lines / np.maximum(lines, 1),
            repeat_words / some,
            per_text(_UPPER[data], offsets) / np.maximum(letters, 1),
            per_text(_DIGIT[data], offsets) / size,
            per_text(_PUNCT[data], offsets) / size,
            letters / size,
            np.log1p(n_words / np.maximum(lines, 1)),
            distinct / some / np.maximum(some, 1) ** -0.1,
        ],
        axis=1,
    )
    return base, ratios


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search among n rows."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def grown(good: np.ndarray, every: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """A tree: node, feature, split, path. Splits are drawn over the range that the rows of every kind span, good ones decide where it ends.

    So ways that no good row goes end early, also for a value that good rows never have.
    """
    out = []
    todo = [(1, good, 0, every.min(0), every.max(0))]
    while todo:
        node, own, depth, low, high = todo.pop()
        able = np.flatnonzero(high > low)
        if depth == DEEPEST or len(own) <= 1 or not len(able):
            out.append((node, -1, 0.0, depth + float(average_path(len(own)))))
            continue
        f = rng.choice(able)
        s = rng.uniform(low[f], high[f])
        out.append((node, f, s, 0.0))
        left, below, above = own[:, f] < s, high.copy(), low.copy()
        below[f] = above[f] = s
        todo += [(2 * node, own[left], depth + 1, low, below), (2 * node + 1, own[~left], depth + 1, above, high)]
    return tuple(np.array(c, t) for c, t in zip(zip(*out, strict=True), (np.int32, np.int32, float, float), strict=True))


@dataclass
class IsolationForest:
    """Trees as arrays, node k over 2k and 2k + 1: feature (-1 at leaves), split, path length at leaves."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    scale: float
    threshold: float = np.inf
    held_out_loss: float = 0.0

    @classmethod
    def of(cls, trees: list[tuple[np.ndarray, ...]], size: int) -> IsolationForest:
        """A forest of trees that are given as node, feature, split and path, each grown on size rows."""
        width = 2 ** (DEEPEST + 1)
        feature = np.full((len(trees), width), -1)
        split, path = np.zeros((len(trees), width)), np.zeros((len(trees), width))
        for t, (node, *own) in enumerate(trees):
            for whole, values in zip((feature, split, path), own, strict=True):
                whole[t, node] = values
        return cls(feature, split, path, float(average_path(size)) or 1.0)

    @classmethod
    def grow(cls, good: np.ndarray, every: np.ndarray, trees: int = TREES, size: int = TREE_ROWS, seed: int = SEED) -> IsolationForest:
        """From rows at hand; fit_forest draws from a table."""
        rng = np.random.default_rng(seed)
        size = min(size, len(good))
        own = lambda rows, n: rows[rng.choice(len(rows), min(n, len(rows)), replace=False)]
        return cls.of([grown(own(good, size), own(every, size), rng) for _ in range(trees)], size)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The shorter the mean path, the nearer to 1."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.ones(len(rows), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = rows[every, np.maximum(f, 0)] >= split[node]
                node = np.where(inner, 2 * node + right, node)
            total += path[node]
        return 2.0 ** (-total / len(self.path) / self.scale)


def calibrated(forest: IsolationForest, good: np.ndarray, bad: np.ndarray, max_loss: float = MAX_LOSS) -> IsolationForest:
    """The threshold of least lost good and kept bad rows, as shares, of those that lose at most max_loss of the good."""
    ranked, worse = np.sort(forest.scores(good))[::-1], np.sort(forest.scores(bad))
    at = np.arange(min(int(max_loss * len(good)) + 1, len(good)))
    cost = at * len(bad) + np.searchsorted(worse, ranked[at], "right") * len(good)
    forest.threshold = float(ranked[np.argmin(cost)])
    forest.held_out_loss = float(np.mean(ranked > forest.threshold))
    return forest


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of every document, without its text: id, a hash of the text, the base ones and the ratios as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(2)):
                base, ratios = statistics(data, offsets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, ratios.size + 1, ratios.shape[1]), pa.int32()), pa.array(ratios.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(2)), *(pa.array(base[c], pa.int64()) for c in BASE), flat], names=["id", "turn", *BASE, "ratios"])

    schema = "id long, turn long, " + "".join(f"{c} long, " for c in BASE) + "ratios array<double>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("turn"), F.col(text_col)).mapInArrow(run, schema)


def matrix(ratios: pa.Array) -> np.ndarray:
    return np.asarray(ratios.flatten()).reshape(-1, len(RATIOS))


def agreed(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """id and label of the ids whose labels are there and don't contradict each other."""
    own = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label).alias("a"), F.max(label).alias("b"))
    return own.where("a = b").select("id", F.col("a").alias("label"))


def labelled_rows(measured: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """(id, good, growing, ratios) of all labelled ids that pass the base rule, by their text of the least hash."""
    passed = (F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words"))
    # an id's rows are combined before they meet, so that none is heavy
    one = measured.where("id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct(passed.alias("passed"), "ratios"), F.struct("turn", "n_words")).alias("r")).where("r.passed")
    own = agreed(labels, "quality", id_col).where("label IN (0, 1)")
    return one.join(own, "id").select("id", (F.col("label") == 1).alias("good"), (F.pmod(F.xxhash64("id"), F.lit(2)) == 0).alias("growing"), "r.ratios")


def drawn(rows: DataFrame, n_good: int, n: int, trees: int = TREES, size: int = TREE_ROWS, seed: int = SEED) -> DataFrame:
    """(tree, good, turn, id, ratios): rows that may be of the size least of a tree, in the order of a hash of tree and id.

    There is an order for the good rows and one for all. Half as many again as are wanted come by a bound on the
    hash, so lines are bounded by trees and size; fewer than wanted come once in 10 ** 8 fits.
    """
    bounds = {good: min(int(1.5 * size * 2**64) // max(total, 1), 2**64 - 1) for good, total in ((True, n_good), (False, n))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(0)).view(np.uint64)
            is_good = np.asarray(batch.column(1).cast(pa.int8())).astype(bool)
            found = []
            for good, bound in bounds.items():
                some = np.flatnonzero(is_good) if good else np.arange(len(own))
                salted = mix(own[some] + np.uint64(2 * seed + good))
                for t in range(trees):
                    turn = mix(salted ^ mix(np.array([t + 1], np.uint64)))
                    hit = np.flatnonzero(turn <= np.uint64(bound))
                    found.append((np.full(len(hit), t, np.int32), np.full(len(hit), good), (turn[hit] >> np.uint64(1)).astype(np.int64), some[hit]))
            tree, kind, turn, at = (np.concatenate(c) for c in zip(*found, strict=True))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(kind), pa.array(turn), batch.column(0).take(pa.array(at)), batch.column(2).take(pa.array(at))], names=["tree", "good", "turn", "id", "ratios"])

    return rows.select("id", "good", "ratios").mapInArrow(run, "tree int, good boolean, turn long, id long, ratios array<double>")


def grow_drawn(draws: DataFrame, size: int = TREE_ROWS, seed: int = SEED) -> list[tuple[np.ndarray, ...]]:
    """A tree of each group of drawn rows, in order."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("turn", "ascending"), ("id", "ascending")])
        good = np.asarray(rows.column("good").combine_chunks().cast(pa.int8())).astype(bool)
        ratios, t = matrix(rows.column("ratios").combine_chunks()), rows.column("tree")[0].as_py()
        made = grown(ratios[good][:size], ratios[~good][:size], np.random.default_rng((seed, t)))
        return pa.table([pa.array([t], pa.int32()), *(pa.array([c.tolist()], pa.list_(pa.from_numpy_dtype(c.dtype))) for c in made)], names=names)

    names = ["tree", "node", "feature", "split", "path"]
    trees = draws.groupBy("tree").applyInArrow(run, "tree int, node array<int>, feature array<int>, split array<double>, path array<double>")
    return [tuple(np.array(c) for c in t[1:]) for t in sorted(trees.collect(), key=lambda t: t.tree)]  # TREES rows


def with_scores(rows: DataFrame, forest: IsolationForest) -> DataFrame:
    """(good, score) of rows (good, ratios)."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(matrix(batch.column(1))))], names=["good", "score"])

    return rows.select("good", "ratios").mapInArrow(run, "good boolean, score double")


def best_threshold(scored: DataFrame, n_good: int, n_bad: int, max_loss: float = MAX_LOSS) -> tuple[float, float]:
    """What calibrated finds, over a table (good, score): the threshold, and the share of good rows that it loses.

    Counts of the rows above a score are those of the ranges above its own, which the driver adds up, and those within its range.
    """
    by_score = scored.groupBy("score").agg(F.count(F.when(F.col("good"), 1)).alias("g"), F.count(F.when(~F.col("good"), 1)).alias("b"))
    counts = materialise(by_score.withColumn("bin", F.floor(F.col("score") * BINS).cast("int")), "scores")
    bins = sorted(counts.groupBy("bin").agg(F.sum("g").alias("g"), F.sum("b").alias("b")).collect(), key=lambda r: -r.bin)
    above = np.cumsum([(0, 0), *((r.g, r.b) for r in bins)], axis=0).tolist()
    most = min(int(max_loss * n_good), n_good - 1)
    tops = [(r.bin, *a) for r, a in zip(bins, above, strict=False) if a[0] <= most]
    starts = scored.sparkSession.createDataFrame(tops, "bin int, above_g long, above_b long")
    higher = Window.partitionBy("bin").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c: F.col(f"above_{c}") + F.coalesce(F.sum(c).over(higher), F.lit(0))
    told = counts.join(F.broadcast(starts), "bin").select("score", "g", over("g").alias("lost"), (n_bad - over("b")).alias("left"))
    cost = F.col("lost") * n_bad + F.col("left") * n_good
    best = told.where((F.col("g") > 0) & (F.col("lost") <= most)).orderBy(cost, F.col("score").desc()).first()
    return best.score, best.lost / n_good


def fit_measured(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> IsolationForest | None:
    """Grown and calibrated on the statistics of all labelled rows; None without rows of both kinds."""
    good, growing = F.col("good"), F.col("growing")
    kinds = {"grow_good": growing & good, "grow_bad": growing & ~good, "set_good": ~growing & good, "set_bad": ~growing & ~good}
    rows, n = materialise_counted(labelled_rows(measured, labels, id_col), "labelled-statistics", *(F.count(F.when(c, 1)).alias(k) for k, c in kinds.items()))
    n_good, n_bad = n.grow_good + n.set_good, n.grow_bad + n.set_bad
    if n_good < 2 or not n_bad:
        return None
    if n.grow_good < 2 or not n.set_good or not n.set_bad:
        grow, own, setting, other = rows, (n_good, n.n), rows, (n_good, n_bad)
    else:
        grow, own, setting, other = rows.where(growing), (n.grow_good, n.grow_good + n.grow_bad), rows.where(~growing), (n.set_good, n.set_bad)
    forest = IsolationForest.of(grow_drawn(drawn(grow, *own)), min(TREE_ROWS, own[0]))
    forest.threshold, forest.held_out_loss = best_threshold(with_scores(setting, forest), *other)
    return forest


def fit_forest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> IsolationForest | None:
    return fit_measured(measure(docs, id_col, text_col), labels, id_col)


def verdict(base: dict[str, np.ndarray], ratios: np.ndarray, forest: IsolationForest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, score and kept."""
    failed = base_failed(base)
    if forest is None:
        return failed, np.zeros(len(ratios)), ~failed
    score = forest.scores(ratios)
    return failed, score, ~failed & (score <= forest.threshold)


def judge(measured: DataFrame, forest: IsolationForest | None, id_col: str = "doc_id") -> DataFrame:
    """id, the base statistics, base_failed, score and kept."""
    shared = measured.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = verdict({c: np.asarray(batch.column(c)) for c in BASE}, matrix(batch.column("ratios")), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(c) for c in BASE), *map(pa.array, told)], names=names)

    schema = f"{id_col} long, " + "".join(f"{c} long, " for c in BASE) + "base_failed boolean, score double, kept boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    return measured.mapInArrow(run, schema)


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    measured = materialise(measure(docs, id_col, text_col), "statistics")
    return judge(measured, fit_measured(measured, labels, id_col), id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns; they are measured again rather than joined to their verdicts."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_forest(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [verdict(*statistics(data, offsets), shared.value)[2] for _, _, data, offsets in blocks(batch.column(at))]
            if mask:
                yield batch.filter(pa.array(np.concatenate(mask)))

    return docs.mapInArrow(run, docs.schema)
