"""Order within a key: runs, sections, streaks, previous rows and recent distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous(df: DataFrame, keys: list[str], order: list[str], column: str, into: str) -> DataFrame:
    """W03, J14."""
    return df.withColumn(into, F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))


def runs(df: DataFrame, keys: list[str], order: list[str], value: Column, into: str = "run") -> DataFrame:
    """Number the runs of equal value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce((F.lag(value).over(w) != value).cast("int"), F.lit(0))
    return df.withColumn("__changed", changed).withColumn(into, F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__changed")


def longest_streak(df: DataFrame, keys: list[str], order: list[str], hit: Column) -> DataFrame:
    """The longest run of hits of each key, 0 where there is none."""
    numbered = runs(df.withColumn("__hit", hit), keys, order, F.col("__hit"))
    lengths = numbered.groupBy(*keys, "run").agg(F.sum(F.col("__hit").cast("long")).alias("n"))
    return lengths.groupBy(*keys).agg(F.max("n").alias("longest"))


def sections(df: DataFrame, keys: list[str], order: list[str], heading: Column, into: str = "section") -> DataFrame:
    """The number of headings up to each row."""
    return df.withColumn(into, F.sum(heading.cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def recent_distinct(df: DataFrame, key: str, value: str, when: str, tie: str, n: int) -> DataFrame:
    """Each key's last n values, the newest first, a repeated one once."""
    last = df.groupBy(key, value).agg(F.max(F.struct(when, tie)).alias("last"))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("last")))).where(F.col("rank") <= n).select(key, value, "rank")


def replaced_pairs(old: DataFrame, new: DataFrame, block: list[str], path: str, pos: str, text: str) -> DataFrame:
    """Within a block old and new lines of one path meet in order; what is left is removed or added."""
    w = Window.partitionBy(*block, path).orderBy(pos)
    a = old.select(*block, path, F.col(text).alias("before"), F.row_number().over(w).alias("nth"))
    b = new.select(*block, path, F.col(text).alias("after"), F.row_number().over(w).alias("nth"))
    kind = F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").otherwise("changed")
    return a.join(b, [*block, path, "nth"], "full_outer").withColumn("kind", kind)
