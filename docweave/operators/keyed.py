"""Operators on keys: latest and first rows, modes, ordered unions, fingerprints.

Rows per key are found by combinable aggregates over structs, not by sorting a key's rows in one
task, so a hot key costs one row per input partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one(df: DataFrame, keys: list[str], order: list[Column], best) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = best(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("__row")).select(*keys, *[F.col("__row").getField(c).alias(c) for c in rest]).select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The row of each key that comes first in an order without ties."""
    return _one(df, keys, [F.col(c) if isinstance(c, str) else c for c in order], F.min_by)


def last_per_key(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The row of each key that comes last in an order without ties."""
    return _one(df, keys, [F.col(c) if isinstance(c, str) else c for c in order], F.max_by)


def mode_first_seen(df: DataFrame, keys: list[str], value: str, pos: str | Column) -> DataFrame:
    """The most frequent value of each key; of ties the one seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias(value), F.max("n").alias("n"))


def ordered_union(df: DataFrame, keys: list[str], value: str, pos: str | Column, sep: str = ",") -> DataFrame:
    """The distinct values of each key in the order first seen, joined."""
    firsts = df.groupBy(*keys, value).agg(F.min(pos).alias("p"))
    return firsts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", value))), lambda s: s.getField(value)), sep).alias(value), F.count("*").alias("n"))


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Equal for equal rows in any order, repeats counted."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def equal_groups(df: DataFrame, key: Column, member: str) -> DataFrame:
    """Size and smallest member of the rows of one content."""
    return df.groupBy(key.alias("h")).agg(F.count("*").alias("n"), F.min(member).alias("first"))


def conditional_counts(df: DataFrame, keys: list[str | Column], **tests: Column) -> DataFrame:
    """How many rows of each key pass each test."""
    return df.groupBy(*keys).agg(*[F.count_if(test).alias(name) for name, test in tests.items()])


def latest_per_key(df: DataFrame, key: str, date: str, into: str = "latest") -> DataFrame:
    """A02."""
    return df.groupBy(key).agg(F.max(date).alias(into))


def last_stamp(df: DataFrame, *stamps: str) -> DataFrame:
    """The latest of each row's first stamp that isn't null."""
    return df.agg(F.max(F.coalesce(*stamps)).alias("stamp"))


def with_bodies(documents: DataFrame, bodies: DataFrame, hash_: str = "h") -> DataFrame:
    """Documents with their bodies; the empty hash has none and its documents stay."""
    return documents.join(bodies.where(F.col(hash_) != ""), hash_, "left")


def multiset_changes(lines: DataFrame, old: Column, line: str) -> DataFrame:
    """(kind, line, n): how many more times a line stands in the old rows (removed) or in the others (added)."""
    counts = lines.groupBy(line).agg(F.count_if(old).alias("a"), F.count_if(~old).alias("b"))
    kinds = F.array(F.struct(F.lit("removed").alias("kind"), (F.col("a") - F.col("b")).alias("n")), F.struct(F.lit("added").alias("kind"), (F.col("b") - F.col("a")).alias("n")))
    return counts.select(line, F.explode(kinds).alias("x")).select("x.kind", line, "x.n").where("n > 0")


def used_by_any(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The distinct references of several tables of the same columns."""
    for other in others:
        first = first.unionByName(other)
    return first.distinct()


def overlapping_batches(batches: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Batches that overlap, each key once, from the earliest batch that has it."""
    every = None
    for n, batch in enumerate(batches):
        own = batch.withColumn("__batch", F.lit(n))
        every = own if every is None else every.unionByName(own)
    return first_per_key(every, keys, "__batch", order).drop("__batch")


def store_statistics(rows: DataFrame, sums: dict[str, str], distinct: dict[str, str], **tests: Column) -> DataFrame:
    """One row: how many rows there are and pass each test, sums of columns and numbers of their distinct values."""
    return rows.agg(
        F.count("*").alias("docs"),
        *[F.count_if(test).alias(name) for name, test in tests.items()],
        *[F.sum(c).alias(name) for name, c in sums.items()],
        *[F.count_distinct(c).alias(name) for name, c in distinct.items()],
    )
