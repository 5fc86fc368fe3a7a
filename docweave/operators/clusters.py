"""Greedy clusters of similar keys without a serial pass.

In order, a key joins the first cluster whose first key is similar enough, or opens a cluster. So
the first keys are the lexicographically first maximal independent set of the graph of similar
keys, which needs no pass over all keys: keys are taken in stretches that grow eightfold; within a stretch
only its own edges decide, in rounds in which a key without an open earlier neighbour opens a
cluster and its neighbours join; later keys that are similar to a cluster of the stretch join it
and are never looked at again. A large group of near copies is gone after the stretch that has
its first key, so its keys aren't compared with each other.

Similar keys are found by their grams (runs of characters, the n-th equal one told apart from the first),
rarest first: similar keys share SHARED of their first few (all that they must share, if less), at places that leave room
for as many more as they must share. What is found so is compared whole. Grams go by a shuffle once, packed, a row for each
task and bucket of their hashes; those that one key alone has, which are nearly all, end there, and the lines of the
others are the only ones that are joined. Texts follow only pairs that were met.

State is in tables in the shared folder. Only counts of the input partitions, and sizes of grams'
hash classes, a byte for each of CLASSES from ORDERERS tasks, come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.diffs import ratio
from docweave.operators.numbering import numbered_rows
from docweave.sources.tables import removed, with_ids, written

#: The first stretch of keys and how much longer the next ones are; edges that one task orders.
FIRST, GROWTH, ONE_TASK = 1024, 8, 200_000
#: Classes of grams; keys, characters of each and tasks that the order of grams is taken from.
CLASSES, SAMPLE, SAMPLE_CHARS, ORDERERS = 1 << 22, 20_000, 20_000, 8
#: Of how many more first grams similar keys share that many: each takes one line a key, and keys that share less aren't compared.
SHARED = 8
#: Characters of a bucket, lines that are packed at once, and pairs that are compared at once.
BUCKET, PACKED, COMPARED = 1 << 22, 1 << 20, 128
#: Characters of keys whose grams go at once, lines that are joined at once, and in how many parts more of them go.
PART, LINES, PARTS = 1 << 26, 1 << 23, 4


def points(key: str) -> np.ndarray:
    return np.frombuffer(key.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    out = x >> np.uint64(29)
    out ^= x
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out


def runs_of(key: str, width: int) -> np.ndarray:
    """Sorted hashes of the runs of width characters; a shorter key that isn't empty is one run."""
    own = points(key)
    if not len(own):
        return own
    width, n = min(width, len(own)), 1
    out = mixed(own + (np.uint64(width) << np.uint64(32)))
    while n < width:  # two runs side by side, or overlapping at last, make a longer one
        step = min(n, width - n)
        left = mixed(out[:-step])
        left += out[step:]
        out = left
        n += step
    out = mixed(out)
    out ^= out >> np.uint64(32)
    out.sort()
    return out


def numbered(runs: np.ndarray) -> np.ndarray:
    """Sorted runs as grams: the n-th of equal ones is another than the first."""
    at = np.arange(len(runs))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], runs[1:] != runs[:-1]))[: len(runs)], at, 0))
    return (runs ^ (runs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + (at - first).astype(np.uint64)


@dataclass(frozen=True)
class Grams:
    """Twice the shared runs of width characters, repeats counted, over the runs of both keys.

    Wide runs are rare in whole texts, so few texts are compared; for names and short sentences take two to four.
    """

    width: int = 16
    least: float = 0.8

    def size(self, key: str, grams: int) -> int:
        return grams

    def shared(self, a: int, b: int) -> int:
        """How many grams similar keys of these sizes share at least."""
        return math.ceil(self.least * (a + b) / 2 - 1e-9)

    def shared_column(self, a: Column, b: Column) -> Column:
        return F.ceil(self.least * (a + b) / 2 - 1e-9)

    def similar(self, new: str, old: str, grams: dict[str, np.ndarray]) -> bool:
        x, y = grams[new], grams[old]
        return len(x) + len(y) > 0 and 2 * len(np.intersect1d(x, y, assume_unique=True)) >= self.least * (len(x) + len(y)) - 1e-9


@dataclass(frozen=True)
class Ratio:
    """T03, found by pairs of characters.

    Of T characters in both keys M are matched on each side, in stretches that are at most one more than the
    T - 2M others, and a stretch of m characters shares m - 1 pairs: at least 3M - T - 1 in all.
    """

    least: float = 0.8
    width: int = 2

    def __post_init__(self):
        if self.least <= 2 / 3:
            raise ValueError("pairs of characters find similar keys only above two thirds")

    def size(self, key: str, grams: int) -> int:
        return len(key)

    def shared(self, a: int, b: int) -> int:
        return math.ceil((1.5 * self.least - 1) * (a + b) - 1 - 1e-9)

    def shared_column(self, a: Column, b: Column) -> Column:
        return F.ceil((1.5 * self.least - 1) * (a + b) - 1 - 1e-9)

    def similar(self, new: str, old: str, grams: dict[str, np.ndarray]) -> bool:
        return ratio(new, old) >= self.least


Measure = Grams | Ratio


def shortest_partner(measure: Measure, size: int) -> int:
    return math.ceil(size * measure.least / (2 - measure.least) - 1e-9)


def first_grams(measure: Measure, key: str, order: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(size, grams, those of which similar keys share SHARED), rarest first; of sizes that may share none, their lengths stand for grams."""
    runs = runs_of(key, measure.width)
    grams, count = numbered(runs), len(runs)
    size = measure.size(key, count)
    # how common its class is comes first in a gram, so one sort has the rarest first
    grams = (order[(runs >> np.uint64(40)).astype(np.int64) & (CLASSES - 1)].astype(np.uint64) << np.uint64(56)) | (grams >> np.uint64(8))
    shared = measure.shared(size, shortest_partner(measure, size))
    few = max(count - max(shared, 1) + SHARED, 0)
    own = np.sort(np.partition(grams, few)[:few] if few < count else grams)
    if size and shared <= 0:
        partners = [n for n in range(size, 2 * size + 2) if shortest_partner(measure, n) <= size and measure.shared(size, n) <= 0]
        own = np.concatenate((own, np.array(sorted({size, *partners}), np.uint64)))
    return size, count, own


def gram_order(keys: DataFrame, measure: Measure, n: int) -> np.ndarray:
    """How common the grams of each hash class are, in a sample of the keys; the order changes what is compared, never what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = np.zeros(CLASSES, np.int64), [], 0
        for batch in batches:
            for key in batch.column(0).to_pylist():
                runs = runs_of(key, measure.width)
                held.append((runs[np.concatenate(([True], runs[1:] != runs[:-1]))[: len(runs)]] >> np.uint64(40)) % np.uint64(CLASSES))
                size += len(held[-1])
                if size >= CLASSES:
                    seen += np.bincount(np.concatenate(held).astype(np.int64), minlength=CLASSES)
                    held, size = [], 0
        if held:
            seen += np.bincount(np.concatenate(held).astype(np.int64), minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(seen, 255).astype(np.uint8).tobytes()], pa.binary())], names=["seen"])

    some = keys.where(F.pmod("rank", F.lit(max(1, n // SAMPLE))) == 0).select(F.substring("key", 1, SAMPLE_CHARS).alias("key"))
    out = np.zeros(CLASSES, np.int64)
    for r in some.coalesce(ORDERERS).mapInArrow(run, "seen binary").toLocalIterator():
        out += np.frombuffer(r.seen, np.uint8)
    return np.minimum(out, 255).astype(np.uint8)


def group_name(columns: list[str]) -> Column:
    """A group's values as one string; nulls are a value of their own."""
    return F.to_json(F.struct(*columns)) if columns else F.lit("")


def ranked_keys(df: DataFrame, group: list[str], key: str, order: list[str]) -> tuple[DataFrame, int]:
    """(g, digest, key, first, times, rank) of the different keys of each group, ranked by where they come first; and their number.

    Digests alone are counted and sorted; the text of each first row goes by one shuffle, and copies of it are spread.
    """
    rows = df.select(group_name(group).alias("g"), F.unhex(F.sha2(key, 256)).alias("digest"), F.struct(*order).alias("first"), F.col(key).alias("key"))
    firsts = rows.groupBy("g", "digest").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("times"))
    ranks, n = numbered_rows(firsts, ["first", "g", "digest"], "rank", freed=True)
    by = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in ("first", "g", "digest")]
    found = ranks.join(rows.toDF("f_g", "f_digest", "f_first", "key"), by[0] & by[1] & by[2]).dropDuplicates(["first", "g", "digest"])
    return written(found.select("g", "digest", "key", "first", "times", "rank"), "keys", freed=True), n


def packed_grams(keys: DataFrame, measure: Measure, order: np.ndarray, buckets: int, part: int, parts: int) -> DataFrame:
    """Of the first grams of the keys those of one part of all hashes, in a row for each bucket and pack of keys.

    A line is the lower half of its gram and its distance from the line before; the pack's own row, without grams, tells whose lines
    they are: of each key its rank, size, number of grams and of lines. A pack is named by its first rank.
    """
    shared = keys.sparkSession.sparkContext.broadcast(order)

    def packed(held: list[tuple[int, int, int, np.ndarray]], salts: list[int]) -> pa.RecordBatch:
        counts = np.array([len(own) for *_, own in held], np.int64)
        gram = (np.concatenate([own for *_, own in held]) ^ np.repeat(np.array(salts, np.int64).astype(np.uint64), counts)) * np.uint64(0x9E3779B97F4A7C15)
        bucket = (gram >> np.uint64(32)) % np.uint64(buckets * parts)
        at = np.flatnonzero(bucket % np.uint64(parts) == part)
        bucket = (bucket[at] // np.uint64(parts)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        by = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[by], np.arange(buckets + 1))
        pack = held[0][0]
        out = [(pack % buckets, pack, np.array([(*x, n) for (*x, _), n in zip(held, counts.tolist(), strict=True)], np.int64).tobytes(), None)]
        for k in np.flatnonzero(np.diff(ends)):
            own = at[by[ends[k] : ends[k + 1]]]
            gaps = np.diff(own, prepend=0)
            out.append((int(k), pack, gaps.astype(np.uint16 if gaps.max() < 1 << 16 else np.uint32).tobytes(), gram[own].astype(np.uint32).tobytes()))
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "pack", "lines", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, salts, lines = [], [], 0
        for batch in batches:
            for rank, salt, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                size, total, own = first_grams(measure, key.as_py(), shared.value)
                if len(own):
                    held.append((rank, size, total, own))
                    salts.append(salt)
                    lines += len(own)
                if lines >= PACKED:
                    yield packed(held, salts)
                    held, salts, lines = [], [], 0
        if held:
            yield packed(held, salts)

    return keys.select("rank", F.xxhash64("g"), "key").mapInArrow(run, "bucket int, pack long, lines binary, grams binary")


def met_lines(packed: DataFrame, part: int) -> DataFrame:
    """Of packed lines, dealt and sorted by bucket, those whose gram another line has too; rows of packs pass."""

    def met(number: int, rows: list[tuple[int, bytes, bytes | None]]) -> pa.RecordBatch:
        out = [(part, number, pack, lines, None) for pack, lines, grams in rows if grams is None]
        rows = [r for r in rows if r[2] is not None]
        if rows:
            counts = [len(r[2]) // 4 for r in rows]
            ends = np.cumsum([0, *counts])
            grams = np.frombuffer(b"".join(r[2] for r in rows), np.uint32)
            by = np.argsort(grams, kind="stable")
            same = grams[by][1:] == grams[by][:-1]
            several = np.zeros(len(grams), bool)
            several[by[1:][same]] = several[by[:-1][same]] = True
            for k, (pack, lines, _) in enumerate(rows):
                own = np.flatnonzero(several[ends[k] : ends[k + 1]])
                if len(own):
                    at = np.cumsum(np.frombuffer(lines, np.uint16 if len(lines) == 2 * counts[k] else np.uint32), dtype=np.int64)
                    out.append((part, number, pack, at[own].astype(np.int32).tobytes(), grams[ends[k] : ends[k + 1]][own].tobytes()))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "bucket", "pack", "lines", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            for number, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if number != now:
                    if held:
                        yield met(now, held)
                    now, held = number, []
                held.append(row)
        if held:
            yield met(now, held)

    return packed.mapInArrow(run, "part int, bucket int, pack long, lines binary, grams binary")


def gram_table(keys: DataFrame, measure: Measure, order: np.ndarray, bucket: int = BUCKET) -> DataFrame:
    """A written line for each of a key's first grams that another key has too; grams of different groups don't meet.

    Grams are told apart by their bucket and 32 bits: the few that fall together are only compared. All hashes go in up to
    PARTS parts, one after the other, so that only one part's lines are on disk at a time; each part makes the grams anew.
    """
    spark = keys.sparkSession
    chars = keys.agg(F.sum(F.length("key"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(PARTS, 1 + chars // PART)
    buckets = max(tasks, math.ceil(chars / (bucket * parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, bucket, _, lines, grams in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if grams is None:
                    ranks, sizes, totals, counts = np.frombuffer(lines, np.int64).reshape(-1, 4).T
                    ends = np.cumsum(counts)
                    continue
                at = np.frombuffer(lines, np.int32)
                which = np.searchsorted(ends, at, side="right")
                gram = np.frombuffer(grams, np.uint32).astype(np.int64) | np.int64((bucket * parts + part) << 32)
                left = np.maximum(totals[which] - (at - ends[which] + counts[which]), 0)
                yield pa.RecordBatch.from_arrays([pa.array(ranks[which]), pa.array(gram), pa.array(sizes[which]), pa.array(left)], names=["rank", "gram", "size", "left"])

    out = None
    for part in range(parts):
        packed = packed_grams(keys, measure, order, buckets, part, parts).repartition(tasks, "bucket").sortWithinPartitions("bucket")
        lines = written(met_lines(packed, part), "lines", freed=True)
        # a pack's own row comes before its lines
        dealt = lines.repartition(tasks, "pack").sortWithinPartitions("pack", F.col("grams").isNotNull())
        grams = written(dealt.mapInArrow(run, "rank long, gram long, size long, left long"), "grams", freed=True)
        removed(lines)
        out = grams if out is None else out.unionByName(grams)
    return out


def compared(late: DataFrame, early: DataFrame, keys: DataFrame, measure: Measure, parts: int = 1) -> DataFrame:
    """(late, early): pairs of ranks whose keys are similar, of those that share a first gram. left counts a key's grams from that one on.

    Lines are joined in parts of all grams, one after the other.
    """
    met = None
    for part in range(parts):
        a, b = (df.where(F.pmod("gram", F.lit(parts)) == part) if parts > 1 else df for df in (late, early))
        a = a.select(F.col("rank").alias("late"), "gram", F.col("size").alias("late_size"), F.col("left").alias("late_left"))
        b = b.select(F.col("rank").alias("early"), "gram", F.col("size").alias("early_size"), F.col("left").alias("early_left"))
        bound = measure.shared_column(F.col("late_size"), F.col("early_size"))
        able = (F.col("early") < F.col("late")) & (F.least("late_left", "early_left") + (SHARED - 1) >= bound) & (2 * F.least("late_size", "early_size") >= measure.least * (F.col("late_size") + F.col("early_size")) - 1e-9)
        some = a.join(b, "gram").where(able).groupBy("late", "early").agg(F.count(F.lit(1)).alias("n"), F.first(bound).alias("bound"))
        if parts > 1:
            some = written(some, "met", freed=True)
        met = some if met is None else met.unionByName(some)
    if parts > 1:
        met = met.groupBy("late", "early").agg(F.sum("n").alias("n"), F.first("bound").alias("bound"))
    pairs = written(met.where(F.col("n") >= F.least(F.lit(SHARED), F.greatest(F.lit(1), "bound"))).select("late", "early"), "pairs", freed=True)
    if parts > 1:
        removed(met)

    def texts(side: str) -> DataFrame:
        return with_ids(keys.select("rank", "g", "key"), pairs.select(F.col(side).alias("rank")), "rank")

    both = pairs.join(texts("late").toDF("late", "late_g", "new"), "late").join(texts("early").toDF("early", "early_g", "old"), "early").where("late_g = early_g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COMPARED):
                some = batch.slice(at, COMPARED)
                new, old = some.column("new").to_pylist(), some.column("old").to_pylist()
                grams = {k: numbered(runs_of(k, measure.width)) for k in {*new, *old}} if isinstance(measure, Grams) else {}
                yield some.select(["late", "early"]).filter(pa.array([measure.similar(x, y, grams) for x, y in zip(new, old, strict=True)], pa.bool_()))

    return both.select("late", "early", "new", "old").mapInArrow(run, "late long, early long")


def joined_in_order(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(late, early): each key that joins a cluster, with that cluster's first key; keys that aren't here open one.

    edges holds every pair of similar keys. Few edges are one sorted pass of a task; many go in rounds: a key
    without an open earlier neighbour opens a cluster, its neighbours join.
    """
    if edges.count() <= one_task:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            joined: dict[int, int] = {}
            for batch in batches:  # by late, then early: the first neighbour that has joined nothing is the cluster's
                for late, early in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if late not in joined and early not in joined:
                        joined[late] = early
            yield pa.RecordBatch.from_arrays([pa.array(list(joined), pa.int64()), pa.array(list(joined.values()), pa.int64())], names=["late", "early"])

        return edges.repartition(1).sortWithinPartitions("late", "early").mapInArrow(run, "late long, early long")
    open_, joined = edges, None
    while not open_.isEmpty():
        waiting = open_.select(F.col("late").alias("early")).distinct()
        # an early key that waits for nothing has opened a cluster
        fresh = written(open_.join(waiting, "early", "left_anti").select("late").distinct(), "joined", freed=True)
        joined = fresh if joined is None else written(joined.unionByName(fresh), "joined", freed=True)
        rest = open_.join(fresh, "late", "left_anti").join(fresh.select(F.col("late").alias("early")), "early", "left_anti")
        open_ = written(rest.select("late", "early"), "open", freed=True)
    firsts = edges.join(joined.select(F.col("late").alias("early")), "early", "left_anti").groupBy("late").agg(F.min("early").alias("early"))
    return firsts.join(joined, "late", "left_semi")


def greedy_first_keys(keys: DataFrame, n: int, measure: Measure, first: int = FIRST, one_task: int = ONE_TASK) -> DataFrame:
    """(rank, opened): every key's cluster by the rank of its first key. keys are as ranked_keys gives them."""
    grams = gram_table(keys, measure, gram_order(keys, measure, n))
    found: DataFrame | None = None
    low, high = 0, first
    while low < n:
        own = grams.where(F.col("rank") < high)
        parts = min(PARTS, 1 + grams.count() // LINES)
        edges = written(compared(own, own, keys, measure, parts), "edges", freed=True)
        inside = written(joined_in_order(edges, one_task), "inside", freed=True)
        members = inside
        if high < n:
            opened = own.join(inside.select(F.col("late").alias("rank")), "rank", "left_anti")
            later = grams.where(F.col("rank") >= high)
            outside = written(compared(later, opened, keys, measure, parts).groupBy("late").agg(F.min("early").alias("early")), "outside", freed=True)
            members = inside.unionByName(outside)
            rest = written(later.join(outside.select(F.col("late").alias("rank")), "rank", "left_anti"), "grams", freed=True)
            removed(grams)
            grams = rest
        found = members if found is None else found.unionByName(members)
        low, high = high, high * GROWTH
    removed(grams)
    ranks = keys.select("rank")
    if found is None:
        return ranks.withColumn("opened", F.col("rank"))
    return ranks.join(found.select(F.col("late").alias("rank"), F.col("early").alias("opened")), "rank", "left").select("rank", F.coalesce("opened", "rank").alias("opened"))


def clustered(df: DataFrame, group: list[str], kind: list[str], key: str, order: list[str], measure: Measure | None = None, first: int = FIRST, one_task: int = ONE_TASK) -> DataFrame:
    """A08 over groups: adds cluster, representative (of its most frequent key, of equals the one seen first, the first row) and size.

    Rows of different kinds never meet. cluster is the place, by order, of the row that opened it; with one order column its value.
    order tells a group's rows apart; equal rows are representative together. A null key is like an empty one.
    """
    own = df.withColumn(key, F.coalesce(F.col(key), F.lit("")))
    by = [*group, *kind]
    keys, n = ranked_keys(own, by, key, order)
    at = written(greedy_first_keys(keys, n, measure or Ratio(), first, one_task), "clusters", freed=True)
    place = F.col("first") if len(order) > 1 else F.col("first").getField(order[0])
    of = keys.select("rank", "g", "digest", "first", "times").join(at, "rank")
    best = of.groupBy("opened").agg(F.min(F.struct(-F.col("times"), "first", "digest")).alias("b"), F.sum("times").alias("size"), F.min(F.when(F.col("rank") == F.col("opened"), place)).alias("cluster"))
    marks = written(of.join(best, "opened").select("g", "digest", "cluster", F.when(F.col("digest") == F.col("b.digest"), F.col("first")).alias("lead"), "size"), "marks", freed=True)
    # the rows of a common key are split where the join shuffles; there is one line of marks for each key
    joined = own.withColumn("g", group_name(by)).withColumn("digest", F.unhex(F.sha2(key, 256))).join(marks, ["g", "digest"])
    lead = F.coalesce(F.col("lead") == F.struct(*order), F.lit(False))
    return joined.select(*df.columns, "cluster", lead.alias("representative"), "size")
