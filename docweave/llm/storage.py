"""Shared storage, cut lineage and skew-safe joins used by the operators here."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

#: A group with more than one part in HEAVY of all rows is heavy; there are at most HEAVY such groups per row key.
HEAVY = 512
#: Narrow rows that one task takes whatever their keys (fewer need no split of hot groups), and rows for which a task is worth starting.
ONE_TASK, WORTH = 1_000_000, 4096

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="docweave-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/docweave/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, name: str, *also: Column) -> tuple[DataFrame, Row]:
    """The same, with the number of rows (n) and other aggregates, taken as they are written."""
    spark = df.sparkSession
    path, seen = fresh_path(spark, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), *also).write.parquet(path)
    got = seen.get
    return spark.read.schema(df.schema).parquet(path), Row(**got)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that was written here and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df, in any case, doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def skew_join(rows: DataFrame, groups: DataFrame, key: str | list[str], size: Column, total: int) -> DataFrame:
    """Inner join of rows with groups on key, where groups has one line per key and no nulls, and size is its rows.

    Groups with size over total / HEAVY are at most HEAVY (times the keys a row has), so they
    are broadcast; all others go by a shuffle in which no key holds more than that share. With a
    total of 0 it's the sum of size, taken by a job of its own.
    """
    keys = [key] if isinstance(key, str) else key
    if not total:
        total = groups.agg(F.sum(size)).first()[0] or 0
    heavy = size > F.lit(max(1000, total // HEAVY))
    names = [c for c in groups.columns if c not in keys]
    mark, own = free_name(rows, "hot"), {c: free_name(rows, f"hot_{c}") for c in names}
    hot = F.broadcast(groups.where(heavy).select(*keys, *[F.col(c).alias(own[c]) for c in names], F.lit(True).alias(mark)))
    joined = rows.join(hot, keys, "left")
    hits = joined.where(F.col(mark)).select(*rows.columns, *[F.col(own[c]).alias(c) for c in names])
    rest = joined.where(F.col(mark).isNull()).select(*rows.columns)
    return hits.unionByName(rest.join(groups.where(~heavy), keys).select(*rows.columns, *names))


def tasks(rows: int) -> int:
    """Tasks that narrow rows are worth."""
    return max(1, math.ceil(rows / WORTH))


def beside(rows: DataFrame, keys: list[str], aggregates: dict[str, Column], total: int, one_task: int = ONE_TASK) -> DataFrame:
    """Narrow rows, of which there are about total and none has a null key, with aggregates over the rows of equal keys.

    Up to one_task rows it's one shuffle and a window, in as many tasks as the rows are worth, so that the driver
    doesn't keep hundreds of empty ones; more go by skew_join.
    """
    if total <= one_task:
        own = Window.partitionBy(*keys)
        return rows.select("*", *[c.over(own).alias(n) for n, c in aggregates.items()]).coalesce(tasks(total))
    count = free_name(rows, "count")
    groups = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()], F.count("*").alias(count))
    return skew_join(rows, groups, keys, F.col(count), total).select(*rows.columns, *aggregates)


def split_join(rows: DataFrame, groups: DataFrame, key: str, size: Column, total: int) -> DataFrame:
    """The same for many rows: heavy groups' keys go to the driver first, at most HEAVY times the keys a row has, so that rows are told apart without a join.

    groups is read twice and should be a written table.
    """
    keys = sorted(r[0] for r in groups.where(size > F.lit(max(1000, total // HEAVY))).select(F.xxhash64(key)).collect())
    if not keys:
        return rows.join(groups, key)
    heavy = F.xxhash64(key).isin(keys)
    return rows.where(heavy).join(F.broadcast(groups.where(heavy)), key).unionByName(rows.where(~heavy).join(groups.where(~heavy), key))
