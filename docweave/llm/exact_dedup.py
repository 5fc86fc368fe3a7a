"""Exact dedup by a tree merge of sorted digest runs.

Every input partition makes one run of (digest, best id, rows). Runs meet in rounds of a
radix-r binomial tree: in round k, node p sends the part of its run whose k-th digest digit is
j to node j of its group, so r runs meet in each node. Spark's external sorter, which spills, merges
what arrives, and the sorted stream keeps one line for a digest. After the last round each node owns one range of digests. A group of
copies of any size is one line for each run from the first round on.

Defined results: null text counts as empty; a null id is smaller than any other; rows that
repeat an id and a text are one document; texts of any length are digested whole; an empty table gives an
empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.columnar import blocks
from docweave.llm.storage import free_name, materialise, materialise_counted, partitions_of, skew_join

#: Runs that meet in a node at most: in op1's own tree, and where another operator needs a merge with few stages.
FAN_IN, WIDE = 4, 16


def digest_key(text: bytes) -> bytes:
    """SHA-256 of the text, then what verifies it: another hash and the length."""
    return hashlib.sha256(text).digest() + xxhash.xxh3_64_digest(text) + len(text).to_bytes(8, "big")


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, key) with letters A-Z lower-cased."""
    for batch in batches:
        keys = []
        for _, _, data, offsets in blocks(batch.column(1)):
            raw, at = data.tobytes(), offsets.tolist()
            keys += [digest_key(raw[a:b].lower()) for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["id", "key"])


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(digest_batches, "id long, key binary")


def merging(largest: bool):
    """Merges a node's sorted stream of (key, id, rows, ids): one line for each key."""
    better = (lambda a, b: b is None or (a is not None and a > b)) if largest else (lambda a, b: b is None or (a is not None and a < b))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        for batch in batches:
            out: list[list] = []
            for key, doc, rows, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is None or key != last[0]:
                    if last is not None:
                        out.append(last)
                    last = [key, doc, rows, ids]
                else:
                    last[2] += rows
                    if doc == last[1]:
                        last[3] += ids
                    elif better(doc, last[1]):
                        last[1], last[3] = doc, ids
            if out:
                yield as_batch(out)
        if last is not None:
            yield as_batch([last])

    return merge


def as_batch(lines: list[list]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*lines, strict=True), kinds, strict=True)], names=["key", "keep_id", "group_size", "n_keep"])


def tree_merge(keys: DataFrame, keep: str = "max", partitions: int | None = None, name: str = "runs", fan_in: int = WIDE) -> DataFrame:
    """(id, key) to (key, keep_id, group_size, n_keep): the best id of each key, and how often it stands there."""
    wide = partitions or max(2, partitions_of(keys.sparkSession))
    rounds = max(1, math.ceil(math.log(wide) / math.log(fan_in) - 1e-9))
    radix = max(2, math.ceil(wide ** (1 / rounds) - 1e-9))
    nodes = radix**rounds
    schema = "key binary, keep_id long, group_size long, n_keep long"
    merge = merging(keep == "max")
    runs = keys.select("key", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(1).cast("long").alias("n_keep"))
    runs = runs.sortWithinPartitions("key").mapInArrow(merge, schema)
    bucket = F.pmod(F.conv(F.hex(F.substring("key", 1, 6)), 16, 10).cast("long"), F.lit(nodes))
    place = F.pmod(F.spark_partition_id(), F.lit(nodes)).cast("long")
    for k in range(rounds):
        low = radix**k
        digit = F.floor(bucket / F.lit(low)) % F.lit(radix)
        here = F.floor(F.col("place") / F.lit(low)) % F.lit(radix)
        node = (F.col("place") + (digit - here) * F.lit(low)).cast("int")
        runs = runs.withColumn("place", place).withColumn("node", node).repartitionById(nodes, F.col("node")).select("key", "keep_id", "group_size", "n_keep").sortWithinPartitions("key").mapInArrow(merge, schema)
    return materialise(runs, name)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, text_sha256."""
    keyed, seen = materialise_counted(digests(docs, id_col, text_col), "digests")
    groups = tree_merge(keyed, keep, fan_in=FAN_IN).select("key", "keep_id", "group_size")
    out = skew_join(keyed, groups, "key", F.col("group_size"), max(seen.n, 1))
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The documents that stay, with all their columns."""
    keyed, seen = materialise_counted(digests(docs, id_col, text_col), "digests")
    groups = tree_merge(keyed, keep, fan_in=FAN_IN)
    lost = skew_join(keyed, groups.where("group_size > 1"), "key", F.col("group_size"), max(seen.n, 1)).where("NOT (id <=> keep_id)").select("id", "key").distinct()
    again = groups.where("n_keep > 1").select(F.col("keep_id").alias("id"), "key")
    # where ids repeat, the text's digest tells their rows apart; it's only computed for rows of such ids
    own = {name: free_name(docs, name) for name in ("id", "sha", "lost_id", "lost_sha", "again_id", "again_sha", "again")}
    named = lambda df, a, b: df.select(F.col("id").alias(own[a]), F.lower(F.hex(F.substring("key", 1, 32))).alias(own[b]))
    if not keyed.groupBy("id").count().where("count > 1").head(1):
        return docs.join(named(lost, "lost_id", "lost_sha").drop(own["lost_sha"]), F.col(id_col).cast("long").eqNullSafe(F.col(own["lost_id"])), "left_anti")
    sha = F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)
    wide = docs.withColumn(own["id"], F.col(id_col).cast("long")).withColumn(own["sha"], sha)
    same = lambda a, b: F.col(own["id"]).eqNullSafe(F.col(own[a])) & (F.col(own["sha"]) == F.col(own[b]))
    left = wide.join(named(lost, "lost_id", "lost_sha"), same("lost_id", "lost_sha"), "left_anti")
    left = left.join(named(again, "again_id", "again_sha").withColumn(own["again"], F.lit(True)), same("again_id", "again_sha"), "left")
    once = left.where(F.col(own["again"])).dropDuplicates([own["id"], own["sha"]])
    return left.where(F.col(own["again"]).isNull()).unionByName(once).select(*docs.columns)
