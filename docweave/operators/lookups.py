"""Lookup joins. Spark picks broadcast or shuffle by the sides' sizes; none is forced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(items: DataFrame, nested: str, key: str, store: DataFrame, store_key: str, item_id: str) -> DataFrame:
    """Each item with the first element of its array whose key is in the store: its place, fields and the store's; items without one go."""
    fields = [f for f in items.schema[nested].dataType.elementType.names if f != key]
    opened = items.select(item_id, F.posexplode(nested).alias("pos", "__e")).select(item_id, "pos", F.col(f"__e.{key}").alias(store_key), *[F.col(f"__e.{f}").alias(f) for f in fields])
    hits = opened.join(store, store_key)
    rest = [c for c in hits.columns if c != item_id]
    best = hits.groupBy(item_id).agg(F.min_by(F.struct(*rest), F.struct("pos")).alias("__r"))
    return best.select(item_id, *[F.col(f"__r.{c}").alias(c) for c in rest])


def exact_then_prefix(rows: DataFrame, code: str, prefix: Column, exact: DataFrame, fallback: DataFrame, value: str, full: Column | None = None) -> DataFrame:
    """The value of an equal code; else that of the fallback rows of the same prefix if they agree on one.

    exact has (code, value) with one row per code, fallback (prefix, code, value). full restricts who may fall back.
    Adds value and how: exact, prefix, ambiguous or none.
    """
    agreed = fallback.groupBy("prefix").agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    near = rows.withColumn("prefix", F.when(full if full is not None else F.lit(True), prefix))
    both = near.join(exact.select(F.col(code), F.col(value).alias("__exact")), code, "left").join(agreed, "prefix", "left")
    one = F.col("__low") == F.col("__high")
    how = F.when(F.col("__exact").isNotNull(), "exact").when(one, "prefix").when(F.col("__low").isNotNull(), "ambiguous").otherwise("none")
    return both.withColumn(value, F.coalesce("__exact", F.when(one, F.col("__low")))).withColumn("how", how).drop("prefix", "__exact", "__low", "__high")


def longest_prefix(products: DataFrame, product_id: str, candidates: str, names: DataFrame, name: str, value: str, least: int, most: int = 2) -> DataFrame:
    """The values under the longest candidate that any name begins with, if they are at most most.

    An equi-join on (length, prefix), never a nested loop. Candidates are an array, longest first.
    """
    left = products.select(product_id, F.explode(candidates).alias("prefix"))
    cuts = names.where(F.length(name) >= least).select(name, value, F.explode(F.sequence(F.lit(least), F.length(name))).alias("len"))
    right = cuts.select(F.substring(F.col(name), F.lit(1), F.col("len")).alias("prefix"), value).distinct()
    right = right.join(left.select("prefix").distinct(), "prefix", "left_semi")
    counts = right.groupBy("prefix").agg(F.count("*").alias("n_found"))
    few = right.join(counts.where(F.col("n_found") <= most), "prefix").groupBy("prefix").agg(F.array_sort(F.collect_list(value)).alias("found"))  # at most most of them
    longest = left.join(counts, "prefix").groupBy(product_id).agg(F.max_by(F.struct("prefix", "n_found"), F.length("prefix")).alias("b")).select(product_id, "b.*")
    return longest.join(few, "prefix", "left").select(product_id, "prefix", F.coalesce("found", F.array().cast("array<string>")).alias("found"), F.col("n_found").cast("int").alias("n_found"))


def new_rows(rows: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """J10."""
    return rows.join(stored.select(*on).distinct(), on, "left_anti")


def stale(targets: DataFrame, state: DataFrame, key: str, date: str, version: str, current: int) -> DataFrame:
    """Targets that aren't stored, were stored with another date, or by another version."""
    kept = state.select(key, F.col(date).alias("__date"), F.col(version).alias("__version"))
    joined = targets.join(kept, key, "left")
    why = F.when(F.col("__date").isNull(), "missing").when(F.col("__date") != F.col(date), "changed").when(F.col("__version") != current, "version")
    return joined.withColumn("why", why).where("why IS NOT NULL").drop("__date", "__version")


def referenced(store: DataFrame, targets: DataFrame, key: str, guard: int = 3000) -> DataFrame:
    """The stored rows that targets still name; all of them if targets name suspiciously few different keys."""
    keys = targets.select(key).where(F.col(key).isNotNull()).distinct()
    if keys.limit(guard + 1).count() <= guard:
        return store
    return store.join(keys, key, "left_semi")


def attach_rows(items: DataFrame, item_id: str, rows: DataFrame, pos: str, columns: list[str], into: str) -> DataFrame:
    """The rows of each item as an ordered array; items without any pass with null."""
    lists = rows.groupBy(item_id).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, *columns))), lambda s: F.struct(*[s.getField(c).alias(c) for c in columns])).alias(into))
    return items.join(lists, item_id, "left")


def named(rows: DataFrame, code: str, names: DataFrame, names_code: str) -> DataFrame:
    """Rows with the names that a table has for their code; Spark broadcasts it where it is small."""
    return rows.join(names.withColumnRenamed(names_code, code), code)
