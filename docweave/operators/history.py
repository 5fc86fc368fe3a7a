"""Versions over time: the state of a key at any moment.

Rows and versions are sorted together by key and time over range partitions, so a key with a third
of all rows is cut by time. A partition hands each row the last version that it has met of the row's key; for
keys that go over partitions, of which there are at most two in each, the versions that came before
are handed over. Nothing of a key is held but its last version.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.keyed import last_per_key
from docweave.sources.tables import written


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (k, is_version, version, ...) in order, each row with the last version of its key before it; the last version of each key at the end of its run in the partition."""
    part = TaskContext.get().partitionId()
    held: pa.Table | None = None  # the last version met, if its key may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        own = pa.Table.from_batches([batch])
        every = own if held is None else pa.concat_tables([held, own])
        key, version = every.column("k"), np.asarray(every.column("is_version"))
        codes = np.asarray(key.combine_chunks().dictionary_encode(null_encoding="encode").indices) if key.num_chunks else np.zeros(0)
        fresh = np.concatenate(([True], codes[1:] != codes[:-1]))
        begins = np.maximum.accumulate(np.where(fresh, np.arange(len(codes)), 0))
        last = np.maximum.accumulate(np.where(version, np.arange(len(codes)), -1))
        known = last >= begins
        told = every.column("version").take(pa.array(np.where(known, last, 0), mask=~known))
        out = every.append_column("found", told).append_column("known", pa.array(known)).append_column("part", pa.array(np.full(len(codes), part, np.int32)))
        yield from out.slice(0 if held is None else 1).combine_chunks().to_batches()
        held = every.slice(int(last[-1]), 1) if known[-1] else None


def as_of(rows: DataFrame, versions: DataFrame, key: str, time: str, version_time: str, order: list[str], into: str = "version", strict: bool = False, partitions: int | None = None) -> DataFrame:
    """Every row with the last version (a struct of the versions' columns) of its key at or, with strict, before its time; null without one.

    Of versions of one time the greatest by order counts. Rows with a null key or time and versions with a null time find nothing.
    """
    fields = [c for c in versions.columns if c != key]
    version = F.struct(*fields)
    kept = F.struct(*rows.columns)
    side = lambda is_version: F.lit(int(is_version) if strict else int(not is_version))
    left = rows.select(F.col(key).alias("k"), F.col(time).alias("t"), side(False).alias("side"), F.xxhash64(*rows.columns).alias("h"), F.lit(False).alias("is_version"), F.lit(None).cast(versions.select(version).schema[0].dataType).alias("version"), kept.alias("row"))
    given = versions.where(F.col(version_time).isNotNull() & F.col(key).isNotNull())
    right = given.select(F.col(key).alias("k"), F.col(version_time).alias("t"), side(True).alias("side"), F.lit(0).cast("long").alias("h"), F.lit(True).alias("is_version"), version.alias("version"), F.lit(None).cast(rows.select(kept).schema[0].dataType).alias("row"), F.struct(*order).alias("o"))
    left = left.withColumn("o", F.lit(None).cast(right.schema["o"].dataType))
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["k", "t", "side", "o", "h"]
    ordered = left.unionByName(right).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("o", "h", "side")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields) + f", found {ordered.schema['version'].dataType.simpleString()}, known boolean, part int"
    filled = written(ordered.mapInArrow(_filled, schema), "as-of")
    # the last version of each key in each partition; only keys of several partitions matter, at most two in each
    edges = filled.where("is_version").groupBy("k", "part").agg(F.max_by("version", F.struct("t", F.struct(*[F.col(f"version.{c}") for c in order]))).alias("v"))
    spans = filled.groupBy("k").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b AND k IS NOT NULL")
    parts = spans.select("k", F.explode(F.sequence("a", "b")).alias("part"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = parts.join(edges, ["k", "part"], "left").withColumn("handed", F.last("v", ignorenulls=True).over(before)).where("handed IS NOT NULL").select("k", "part", "handed")
    out = filled.where("NOT is_version").join(F.broadcast(written(handed, "handed-over")), ["k", "part"], "left")
    usable = F.col("t").isNotNull() & F.col("k").isNotNull()
    return out.select("row.*", F.when(usable, F.when(F.col("known"), F.col("found")).otherwise(F.col("handed"))).alias(into))


def state_at(versions: DataFrame, key: str, time: str, moment: object, order: list[str]) -> DataFrame:
    """The version of every key that was in force at a moment; keys that came later have none."""
    return last_per_key(versions.where(F.col(time) <= moment), [key], time, *order)


def intervals(versions: DataFrame, key: str, time: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """Every version with the moments from which and up to which (exclusive, null for the present one) it is in force.

    A version that another of the same time follows is in force for no time and is left out.
    """
    one = last_per_key(versions, [key, time], *order)
    # the next version is the last one before, with time turned round
    turned = one.withColumn("__back", -F.unix_micros(F.col(time).cast("timestamp")))
    nexts = turned.select(key, "__back", F.col(time).alias("valid_to"))
    found = as_of(turned, nexts, key, "__back", "__back", ["__back"], "__next", strict=True, partitions=partitions)
    return found.select(*versions.columns, F.col(time).alias("valid_from"), F.col("__next.valid_to").alias("valid_to"))
