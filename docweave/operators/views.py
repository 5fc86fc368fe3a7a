"""Statistics that follow their table by its changes (A01, A03, A07, A14): nothing that hasn't changed is read again.

A change set has rows with a sign: -1 for a row that goes, 1 for one that comes; a replacement is both. Counts
and sums of a key add up signed rows. What can't be taken back from one number, distinct values, the most frequent one, the
greatest, is read from a multiset: how often a key has each value, where 0 is away. Both are kept
in stores whose rule is to add (sources.deltas), so a batch writes as many lines as it has keys and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGN = "sign"


def change_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """The signed rows that make new of old: rows of what has changed, before and after."""
    return old.withColumn(SIGN, F.lit(-1).cast("long")).unionByName(new.withColumn(SIGN, F.lit(1).cast("long")))


def count_changes(changes: DataFrame, keys: list[str], tests: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """(keys, n, tests, sums): by how much each key's rows, rows that pass each test, and sums change."""
    passed = [F.sum(F.when(t, F.col(SIGN)).otherwise(0)).alias(name) for name, t in tests.items()]
    added = [F.sum(F.coalesce(v, F.lit(0)) * F.col(SIGN)).alias(name) for name, v in sums.items()]
    return changes.groupBy(*keys).agg(F.sum(SIGN).alias("n"), *passed, *added)


def value_changes(changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): by how much the times change that each key has each value; nulls have no value."""
    return changes.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(SIGN).alias("n")).where("n <> 0")


def value_statistics(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, distinct, least, greatest, mode): of a multiset; of equally frequent values the least."""
    return values.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.min(F.struct(-F.col("n"), value)).getField(value).alias("mode"))
