"""Stores, caches and sinks: reads that forgive, writes that are atomic or left out."""

from __future__ import annotations

import gzip
import io
import re
import zipfile
import zlib

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from docweave.functions.keys import BUCKETS, hash_bucket, safe_name
from docweave.operators.keyed import fingerprint

# What cached codes and stored images look like.
CACHE_CODE = r"^[A-Za-z0-9_]{5,80}$"
IMAGE_MAGIC, IMAGE_ENDS, IMAGE_BYTES = (b"GIF8", b"\x89PNG", b"\xff\xd8\xff"), (".gif", ".png", ".jpg", ".jpeg"), 150_000


def read_store(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON with a declared schema; no file, or one that isn't JSON, is an empty table; missing fields are null."""
    own = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], own)
    return whole.select(F.explode(F.from_json("value", ArrayType(own))).alias("r")).select("r.*")  # an object is an array of one, what isn't JSON is null


def moved_aside(spark: SparkSession, path: str, schema: StructType) -> list[str]:
    """Files of a store in which any record isn't JSON of the schema get .bad at their end; their new names."""
    _, bad = split_corrupt(spark, path, schema)
    files = [r[0] for r in bad.select("_file").distinct().collect()]  # as many as there are broken files
    return [renamed(spark, f, f"{f}.bad") for f in files]


def renamed(spark: SparkSession, source: str, target: str) -> str:
    jvm = spark._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    if not old.getFileSystem(spark._jsc.hadoopConfiguration()).rename(old, new):
        raise OSError(f"{source} can't be renamed")
    return target


def newest_first(spark: SparkSession, pattern: str, schema: StructType | str, most: int | None = None) -> DataFrame:
    """The rows of the JSON files that a pattern names, with their file's name, the greatest names first; with most, of so many files.

    The folder is listed and only the files that are wanted are read.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    files = sorted(((s.getPath().getName(), s.getPath().toString()) for s in found if s.isFile()), reverse=True)[:most]
    if not files:
        own = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        return spark.createDataFrame([], StructType([*own.fields, StructField("file", StringType())]))
    rows = spark.read.schema(schema).option("multiLine", True).json([f for _, f in files])
    return rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).orderBy(F.desc("file"))


def split_corrupt(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt records with their file), one JSON record a line."""
    wide = StructType([*schema.fields, StructField("_corrupt", StringType())])
    lines = spark.read.text(path).select(F.input_file_name().alias("_file"), F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return lines.where("r._corrupt IS NULL").select("r.*").drop("_corrupt"), lines.where("r._corrupt IS NOT NULL").select("_file", "r._corrupt")


def with_defaults(config: DataFrame, **defaults: object) -> DataFrame:
    """What a configuration leaves out."""
    return config.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in config.columns else F.lit(v) for k, v in defaults.items()})


def write_days(df: DataFrame, path: str, day: str = "date") -> None:
    """One partition a day; only the days in df are replaced, by Spark's committer."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def current(spark: SparkSession, path: str) -> str | None:
    """The version of a store that is in force, or None: the greatest that was written to its end."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    found = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory()]
    done = [p.getName() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return f"{path}/{max(done)}" if done else None


def read_current(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    at = current(spark, path)
    return spark.createDataFrame([], schema) if at is None else spark.read.schema(schema).parquet(at)


def write_if_changed(df: DataFrame, path: str, keep: int = 2) -> bool:
    """Whether a new version was written; a store of the same rows is left alone.

    A version is a folder of its own and counts once Spark has committed it, so readers see the old rows or the
    new ones, and a write that fails loses nothing. The last keep versions stay.
    """
    spark = df.sparkSession
    at = current(spark, path)
    if at is not None:
        old = spark.read.parquet(at)
        if old.schema == df.schema and fingerprint(old) == fingerprint(df):
            return False
    nth = 0 if at is None else int(at.rsplit("-", 1)[1]) + 1
    df.write.mode("overwrite").parquet(f"{path}/version-{nth:012d}")
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        if status.getPath().getName() <= f"version-{nth - keep:012d}":
            fs.delete(status.getPath(), True)
    return True


def write_buckets(df: DataFrame, path: str, hash_: str, buckets: int = BUCKETS) -> None:
    """A folder for each bucket of a hash, empty ones included, sorted by the hash; earlier buckets go."""
    spark = df.sparkSession
    df.withColumn("bucket", hash_bucket(F.col(hash_), buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", hash_).write.mode("overwrite").partitionBy("bucket").parquet(path)
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for i in range(buckets):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={i:02d}")
        if not fs.exists(folder):
            spark.createDataFrame([], df.schema).write.parquet(folder.toString())


def write_index(df: DataFrame, path: str, *order: str) -> None:
    """One JSON file of a list's rows in order, as pages fetch it; for lists that a browser reads, not for stores."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def read_bucket(spark: SparkSession, path: str, hash_: str, column: str = "h", buckets: int = BUCKETS) -> DataFrame:
    """Reads the one partition that may hold a hash, of a store that was written by that column into so many buckets."""
    return spark.read.parquet(path).where(F.col("bucket") == hash_bucket(F.lit(hash_), buckets)).where(F.col(column) == hash_)


def slim_files(files: Column) -> Column:
    """A single file needs no title."""
    return F.when(F.size(files) == 1, F.transform(files, lambda x: F.struct(x.getField("u").alias("u"), F.lit(None).cast("string").alias("t")))).otherwise(F.transform(files, lambda x: F.struct(x.getField("u").alias("u"), x.getField("t").alias("t"))))


def put_cache(docs: DataFrame, path: str, code: str = "u", xml: str = "xml") -> None:
    """Documents by therapeutic class; codes that aren't safe are left out. Spark compresses and commits."""
    own = docs.where(F.col(code).rlike(CACHE_CODE)).withColumn("class3", F.substring(F.element_at(F.split(code, "_"), 2), 1, 3))
    own.select(code, xml, "class3").write.mode("append").option("compression", "gzip").partitionBy("class3").parquet(path)


def cached(spark: SparkSession, path: str, codes: DataFrame, schema: StructType | str = "u string, xml string, class3 string", code: str = "u") -> DataFrame:
    """The cached documents of some codes; only the folders of their classes are read."""
    wanted = codes.select(code, F.substring(F.element_at(F.split(code, "_"), 2), 1, 3).alias("class3")).distinct()
    return spark.read.schema(schema).parquet(path).join(wanted, [code, "class3"], "left_semi")


def cache_stats(cache: DataFrame, xml: str = "xml") -> DataFrame:
    """Documents and bytes of each class."""
    return cache.groupBy(F.col("class3").cast("string").alias("class3")).agg(F.count("*").alias("n"), F.sum(F.octet_length(xml)).alias("bytes"))


def pruned(cache: DataFrame, targets: DataFrame, code: str = "u") -> DataFrame:
    """S19, K07."""
    return cache.join(targets.select(code).distinct(), code, "left_semi")


@pandas_udf(StringType())
def document_of(raw: pd.Series) -> pd.Series:
    """The first XML member of an archive, an unpacked gzip, or the bytes as they are."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        if b[:2] == b"\x1f\x8b":
            b = gzip.decompress(b)
        elif b[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(b)) as z:
                name = next((n for n in z.namelist() if n.lower().endswith(".xml")), None)
                b = z.read(name) if name else b""
        return b.decode("utf-8-sig", "replace")

    return raw.map(one)


@pandas_udf(StringType())
def decoded_page(raw: pd.Series) -> pd.Series:
    """By the charset that a page declares in its first bytes, else UTF-8."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        said = re.search(rb"charset=[\"']?([\w-]+)", b[:4000], re.I)
        try:
            return b.decode(said[1].decode("ascii", "ignore") if said else "utf-8")
        except (LookupError, UnicodeDecodeError):
            return b.decode("utf-8", "replace")

    return raw.map(one)


def images_in(raw: bytes, wanted: list[str]) -> list[tuple[str, bytes, int]]:
    """(name, bytes, crc) of the wanted members that are images of a sensible size."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        members = {i.filename.lower(): i for i in z.infolist()}
        for name in wanted:
            info = members.get(name.lower())
            if info is None or not name.lower().endswith(IMAGE_ENDS) or not re.match(r"^[A-Za-z0-9_.\-]{1,150}$", name) or not 0 < info.file_size <= IMAGE_BYTES:
                continue
            data = z.read(info)
            if data.startswith(IMAGE_MAGIC):
                out.append((name, data, zlib.crc32(data)))
    return out


@pandas_udf(ArrayType(StructType([StructField("name", StringType()), StructField("content", BinaryType()), StructField("crc", LongType())])))
def extract_images(raw: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("name", "content", "crc"), x, strict=True)) for x in images_in(b, list(w))] for b, w in zip(raw, wanted, strict=True)])


def changed_images(images: DataFrame, stored: DataFrame) -> DataFrame:
    """Images (name, content, crc) that aren't stored with their size and crc."""
    old = stored.select("name", F.length("content").alias("size"), "crc")
    return images.where(safe_name(F.col("name"))).withColumn("size", F.length("content")).join(old, ["name", "size", "crc"], "left_anti").drop("size")
