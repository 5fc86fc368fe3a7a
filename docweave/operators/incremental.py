"""Keyed incremental state in batch form: feed merges, guards and refresh of stale rows (section 2.13)."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: how an error begins that leaves a row out, so that it is tried again.
NOT_FETCHED = "GET failed"


def merge_feed(state: DataFrame | None, batch: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """New keys are added; a row that had failed is replaced where the new one is better; rows not fetched are left out.

    A good stored row always stays, so merging a batch again changes nothing.
    """
    fresh = batch.where(F.col(error).isNull() | ~F.startswith(F.col(error), F.lit(NOT_FETCHED))).withColumn("__age", F.lit(1))
    both = fresh if state is None else state.withColumn("__age", F.lit(0)).unionByName(fresh)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(error).isNotNull(), F.when(F.col(error).isNull(), F.col("__age")).otherwise(-F.col("__age")))).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest if c != "__age"])


def refreshed(state: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """What could be read replaces what is stored; the rest stays as it was."""
    names = [c for c in state.columns if c != key]
    new = read.select(key, *[F.col(c).alias(f"__{c}") for c in names], F.lit(True).alias("__read"))
    return state.join(new, key, "full_outer").select(key, *[F.when(F.col("__read"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in names])


def due(targets: DataFrame, state: DataFrame, key: str, date: str, version: int, retry_errors: bool = False) -> DataFrame:
    """Targets to fetch. A target whose present version has failed before waits, unless errors are retried."""
    kept = state.select(key, F.col(date).alias("__t"), F.col("v").alias("__v"), F.col("err_t").alias("__err_t"))
    joined = targets.join(kept, key, "left")
    changed = F.col("__t").isNull() | (F.col("__t") != F.col(date))
    known_bad = F.lit(False) if retry_errors else F.coalesce(F.col("__err_t") == F.col(date), F.lit(False))
    turn = F.when(changed, 0).when(F.coalesce(F.col("__v") != version, F.lit(True)), 1)
    return joined.withColumn("turn", turn).where(F.col("turn").isNotNull() & ~known_bad).drop("__t", "__v", "__err_t")


def admitted(due_rows: DataFrame, cached: DataFrame, key: str, order: list[str | Column], most: int, every: int) -> DataFrame:
    """What a run reads: every due row whose document is cached, and of the others the first most in an order.

    Adds is_cached and step: rows that are fetched come every to a step, in order; cached ones cost nothing and are in step 0.
    """
    there = cached.select(key).distinct().withColumn("is_cached", F.lit(True))
    known = due_rows.join(there, key, "left").withColumn("is_cached", F.coalesce("is_cached", F.lit(False)))
    first = known.where("NOT is_cached").orderBy(*order, key).limit(most)
    place = F.row_number().over(Window.orderBy(*order, key)) - 1  # at most most rows
    fetched = first.withColumn("step", F.floor(place / every).cast("int"))
    return fetched.unionByName(known.where("is_cached").withColumn("step", F.lit(0)))


def guarded(df: DataFrame, enough: Column, message: str) -> DataFrame:
    """The rows, if a condition on all of them holds; else the job fails before anything is written."""
    check = df.agg(F.assert_true(enough, F.lit(message)).alias("__ok"))
    check.collect()
    return df


def plausible(new: DataFrame, old: DataFrame | None, least: int, share: float = 0.8) -> DataFrame:
    """Refuse a list that is short in itself or against the one before."""
    bound = max(least, int(share * old.count()) if old is not None else 0)
    return guarded(new, F.count("*") >= bound, f"fewer than {bound} rows")


def needs_refresh(now_names: list[str], stored_names: list[str] | None, age_days: int | None, most_days: int = 28) -> bool:
    """I09."""
    return stored_names is None or now_names != stored_names or age_days is None or age_days >= most_days


#: Fixed value: seconds after which a lock counts as left behind.
STALE_LOCK = 6 * 3600


@contextmanager
def locked(spark: SparkSession, path: str, stale: float = STALE_LOCK) -> Iterator[bool]:
    """Whether this run has the lock, a file that only one can create and that holds its owner's token.

    A lock that is too old is taken over by renaming it, of which only one of several runs can rename the lock that it has
    seen, as the new name is made of the old token. At the end a run takes away a lock of its own token only.
    """
    jvm = spark._jvm
    lock = jvm.org.apache.hadoop.fs.Path(path)
    fs = lock.getFileSystem(spark._jsc.hadoopConfiguration())
    token = uuid.uuid4().hex

    def owner() -> str | None:
        if not fs.exists(lock):
            return None
        stream = fs.open(lock)
        try:
            return bytes(stream.readAllBytes()).decode("ascii", "replace")
        finally:
            stream.close()

    def renamed_away(seen: str) -> bool:
        """Whether the lock of that token is out of the way; a lock that another run has put there meanwhile goes back."""
        aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{seen}.{token}")
        if not fs.rename(lock, aside):
            return False
        stream = fs.open(aside)
        got = bytes(stream.readAllBytes()).decode("ascii", "replace")
        stream.close()
        if got != seen:
            fs.rename(aside, lock)
            return False
        fs.delete(aside, False)
        return True

    seen = owner()
    if seen is not None and time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 > stale:
        renamed_away(seen)
    try:
        out = fs.create(lock, False)
    except Exception as e:  # the JVM's error of a file that is there
        if not fs.exists(lock) or isinstance(e, PySparkException):
            raise
        yield False
        return
    out.write(bytearray(token.encode()))
    out.close()
    try:
        yield True
    finally:
        if owner() == token:
            renamed_away(token)
