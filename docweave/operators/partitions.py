"""Planning of capped reads: a class by its children, by years, then date ranges by halves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.keys import middle_day

#: Halvings after which a year is cut into single days.
HALVINGS = 9


def with_children(rows: DataFrame, kind: str, child: str, cap: int, into: str = "class") -> DataFrame:
    """The class that each row is asked for by: its child where its class has over cap rows."""
    full = rows.groupBy(kind).agg(F.count("*").alias("__n"))
    return rows.join(full, kind).withColumn(into, F.when(F.col("__n") > cap, F.col(child)).otherwise(F.col(kind))).drop("__n")


def part(days: Column, low: Column, high: Column) -> Column:
    """The days with rows of a date range, and the range."""
    inside = F.filter(days, lambda d: (d.getField("day") >= low) & (d.getField("day") <= high))
    return F.struct(inside.alias("days"), low.alias("low"), high.alias("high"))


def rows_in(days: Column) -> Column:
    return F.aggregate(days, F.lit(0).cast("long"), lambda n, d: n + d.getField("n"))


def capped_partitions(rows: DataFrame, kind: str, day: str, first_year: int, last_year: int, cap: int) -> DataFrame:
    """(class, low, high, n): date ranges of at most cap rows, single days aside that have more.

    Years before and after the given ones are added where a class has rows there, so that every row of a
    date is in a part. Rows are counted once per class and day; a class's days go down the halvings as an
    array that shrinks with its range, so the cost follows classes and days, not rows.
    """
    counts = rows.where(F.col(day).isNotNull()).groupBy(F.col(kind).alias("class"), F.col(day).alias("day")).agg(F.count("*").alias("n"))
    whole = counts.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("days"), F.min(F.year("day")).alias("first"), F.max(F.year("day")).alias("last"))
    start, end = (lambda y: F.make_date(y, F.lit(1), F.lit(1))), (lambda y: F.make_date(y, F.lit(12), F.lit(31)))
    own = F.struct("days", start(F.least("first", F.lit(first_year))).alias("low"), end(F.greatest("last", F.lit(last_year))).alias("high"))
    parts = whole.select("class", own.alias("p"))
    days, low, high = F.col("p.days"), F.col("p.low"), F.col("p.high")
    over = (rows_in(days) > cap) & (low < high)
    years = F.transform(F.sequence(F.year(low), F.year(high)), lambda y: part(days, start(y), end(y)))
    middle = middle_day(low, high)
    halves = F.array(part(days, low, middle), part(days, F.date_add(middle, 1), high))
    for step in (years, *[halves] * HALVINGS):
        parts = parts.select("class", F.explode(F.when(over, step).otherwise(F.array("p"))).alias("p"))
    return parts.select("class", low.alias("low"), high.alias("high"), rows_in(days).alias("n"))
