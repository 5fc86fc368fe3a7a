"""Substring search by an index of trigrams (F06, Q02-Q08): the rows and totals of a scan, of which only a part is read.

Rows are numbered in the order that results of one score have, and stand in blocks of consecutive numbers. The
index has a line for each trigram and block: the places in the block whose text has it, ascending, which Parquet
writes as differences. Lines are in folders by the trigram's first character and sorted by trigram, so a search
reads the folders and row groups of its words' trigrams; postings of a block are intersected, and only rows that are
left are read, from the folders that hold them, and checked on their text. The best of them are
taken by a bounded heap in each task.

Defined results: a text ends in two characters of its own, so that a word of one or two characters is the beginning
of a trigram; such words read all trigrams that begin so. No words find nothing. Words are looked for as they are:
normalise fields and words alike. Null fields are empty. Equal rows are found each. An index of no rows finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.numbering import numbered_rows
from docweave.operators.search import holds_all, name_score
from docweave.sources.tables import written

#: Rows of a block, blocks of a folder of rows, folders of trigrams; what a text ends in.
BLOCK, BLOCKS, FOLDERS = 4096, 16, 64
#: Characters of the texts whose trigrams a task holds at once.
CHARS = 1 << 20
END = "\uffff\uffff"
GRAMS = "gram string, block long, places array<int>, folder int"


def folder(gram: Column) -> Column:
    """Trigrams of one first character are in one folder."""
    return F.pmod(F.xxhash64(F.substring(gram, 1, 1)), F.lit(FOLDERS)).cast("int")


def build(df: DataFrame, path: str, fields: list[str], order: list[str | Column], block: int = BLOCK) -> None:
    """Write the index of a table's fields, whose results are in an order, under a path that isn't there yet."""
    numbered, _ = numbered_rows(df.withColumns({f: F.coalesce(f, F.lit("")) for f in fields}), order, "number")
    rows = numbered.withColumn("block", (F.col("number") / block).cast("long")).withColumn("part", (F.col("block") / BLOCKS).cast("long"))
    rows.repartitionByRange("part", "number").sortWithinPartitions("part", "number").write.partitionBy("part").parquet(f"{path}/rows")
    rows.limit(0).write.parquet(f"{path}/schema")  # a table of folders without rows has none of its own

    def postings_of(numbers: np.ndarray, texts: list[str]) -> pa.RecordBatch:
        """Of some rows, a line for each trigram and block, with the places of those that have it."""
        units = [np.frombuffer((t + END).encode("utf-32-le"), np.uint32).astype(np.int64) for t in texts]
        own = [np.unique(u[:-2] << 42 | u[1:-1] << 21 | u[2:]) for u in units]
        which = np.repeat(np.arange(len(own)), [len(x) for x in own])
        gram, number = np.concatenate(own), numbers[which]
        by = np.lexsort((number, gram))
        gram, number = gram[by], number[by]
        first = np.flatnonzero(np.concatenate((np.ones(min(len(gram), 1), bool), (gram[1:] != gram[:-1]) | (number[1:] // block != number[:-1] // block))))
        codes = gram[first]
        names = [chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in codes.tolist()]
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(gram)), pa.int32()), pa.array(number % block, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(number[first] // block, pa.int64()), places], names=["gram", "block", "some"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        numbers: list[int] = []
        size = 0
        for batch in batches:
            for number, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append(t.as_py())
                numbers.append(number)
                size += len(held[-1])
                if size >= CHARS or len(held) >= block:
                    yield postings_of(np.array(numbers, np.int64), held)
                    held, numbers, size = [], [], 0
        if held:
            yield postings_of(np.array(numbers, np.int64), held)

    # rows come in the order of their numbers, so those of a task are of few blocks and a trigram's lines are few
    text = rows.select("number", F.concat_ws(" ", *fields).alias("text"))
    lines = text.mapInArrow(grams, "gram string, block long, some array<int>")
    posted = lines.groupBy("gram", "block").agg(F.sort_array(F.flatten(F.collect_list("some"))).alias("places"))  # at most block of them
    filed = posted.withColumn("folder", folder(F.col("gram"))).repartitionByRange("folder", "gram", "block").sortWithinPartitions("folder", "gram", "block")
    filed.write.option("parquet.writer.version", "v2").partitionBy("folder").parquet(f"{path}/grams")


def wanted(words: list[str]) -> list[str]:
    """The trigrams, or for short words their beginnings, that a text with all words has."""
    return sorted({w[i : i + 3] for w in words for i in range(max(len(w) - 2, 1))})


def postings(spark: SparkSession, path: str, needs: list[str]) -> DataFrame:
    """(block, need, places) of what is wanted."""
    heads = sorted({n[:1] for n in needs})
    folders = [r[0] for r in spark.createDataFrame([(h,) for h in heads], "g string").select(folder(F.col("g"))).distinct().collect()]
    meets = lambda n: F.col("gram") == n if len(n) == 3 else F.startswith("gram", F.lit(n))
    lines = spark.read.schema(GRAMS).parquet(f"{path}/grams").where(F.col("folder").isin(folders)).where(reduce(lambda a, b: a | b, map(meets, needs)))
    which = F.filter(F.array(*[F.when(meets(n), F.lit(k)) for k, n in enumerate(needs)]), lambda k: k.isNotNull())
    return lines.select("block", F.explode(which).alias("need"), "places")


def candidates(spark: SparkSession, path: str, words: list[str], block: int) -> DataFrame:
    """(part, number) of rows whose texts have all trigrams of all words."""
    needs = wanted(words)
    of = postings(spark, path, needs).groupBy("block", "need").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    every = of.groupBy("block").agg(F.collect_list("places").alias("all")).where(F.size("all") == len(needs))
    # the shortest list first, so that what is intersected stays small
    short = F.array_sort("all", lambda a, b: F.size(a) - F.size(b))
    left = F.aggregate(F.slice(short, 2, len(needs)), F.element_at(short, 1), F.array_intersect)
    return every.select("block", F.explode(left).alias("place")).select((F.col("block") / BLOCKS).cast("long").alias("part"), (F.col("block") * block + F.col("place")).alias("number"))


def search(spark: SparkSession, path: str, words: list[str], fields: list[str], names: list[str], cap: int | None = 200, block: int = BLOCK) -> DataFrame:
    """The rows whose fields, joined by spaces, hold all words, with score by the first word in names, the best cap of them, and the total of all."""
    rows = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")
    shown = [c for c in rows.columns if c not in ("part", "block", "number")]
    if not words or not all(words):
        return rows.where(F.lit(False)).select(*shown, F.lit(0).alias("score"), F.lit(0).cast("long").alias("total"))
    found = rows.join(candidates(spark, path, words, block), ["part", "number"])
    checked = found.where(holds_all(F.concat_ws(" ", *fields), words)).select("number", *shown, name_score([F.col(f) for f in names], words[0]).alias("score"))
    hits = written(checked, "hits")
    best = hits.orderBy("score", "number")
    total = hits.agg(F.count(F.lit(1))).scalar()
    return (best.limit(cap) if cap else best).select(*shown, "score").withColumn("total", total)
