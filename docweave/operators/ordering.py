"""Orders and columns of lists as they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEW_ENTRY, FIRST_EDITION = "新規", "第1版"


def japanese(c: str | Column) -> Column:
    """A column that sorts by the rules of Japanese."""
    return F.collate(F.col(c) if isinstance(c, str) else c, "ja")


def theme_order(by_name: bool, code: str = "y", name: str = "name") -> list[Column]:
    """By name alone, or by class code and then name."""
    return [japanese(name), F.col(name)] if by_name else [F.col(code), japanese(name), F.col(name)]


def important_first(important: str, pos: str) -> list[Column]:
    """A stable order."""
    return [F.desc(important), F.col(pos)]


def budgeted(rows: DataFrame, turn: Column, pos: list[str], most: int) -> DataFrame:
    """The first rows of a run: those of the least turn first, in order of pos, at most so many."""
    return rows.withColumn("turn", turn).orderBy("turn", *pos).limit(most)


def first_of_group(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """Of each group the first rows in an order, at most so many; a task gives on no more of a group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def newest(df: DataFrame, day: str, most: int) -> DataFrame:
    """The latest distinct days, newest first."""
    return df.select(day).distinct().orderBy(F.desc(day)).limit(most)


def title(brands: Column, brand: Column) -> Column:
    """all brands of a document, or the feed's own."""
    return F.coalesce(F.nullif(F.array_join(F.coalesce(brands, F.array().cast("array<string>")), " / "), F.lit("")), brand, F.lit(""))


def path_list(paths: Column) -> Column:
    """the distinct paths (arrays of headings), sorted and joined."""
    joined = F.transform(F.coalesce(paths, F.array().cast("array<array<string>>")), lambda p: F.array_join(p, " > "))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(joined, lambda p: p != ""))), " / ")


def revision_state(revised: Column, reason: Column, version: Column) -> Column:
    """why there are no revisions to show: marked, new, first_edition or unmarked."""
    return F.when(F.size(F.coalesce(revised, F.array().cast("array<string>"))) > 0, "marked").when(reason == NEW_ENTRY, "new").when(version == FIRST_EDITION, "first_edition").otherwise("unmarked")
