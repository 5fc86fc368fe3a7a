"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Ids that are broadcast at most.
FEW = 500_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where the session names none and runs on one machine (tests)."""
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
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str, freed: bool = False) -> DataFrame:
    """df as a Parquet table that is read back: lineage ends here, and a lost executor costs nothing.

    freed: its shuffle files go once the table is there, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    if freed:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if freed and before is None:
            spark.conf.unset(CLEANUP)
        elif freed:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Takes a written table that nothing reads any more from the shared folder, before the application ends."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if path.rsplit("/", 2)[-2] == "docweave":
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def with_ids(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows whose column name is among the ids of a written table's column of that name, without a shuffle of the others; all rows, if the ids are more than FEW."""
    some = ids.select(name).distinct()
    return rows.join(F.broadcast(some), name, "left_semi") if some.limit(FEW + 1).count() <= FEW else rows
