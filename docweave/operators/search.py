"""Ranked multi-keyword search: filter, score, order and a cap with the uncapped count."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import nfkc, watch_form


def holds_all(blob: Column, words: list[str]) -> Column:
    """F06."""
    out = F.lit(True)
    for w in words:
        out = out & F.contains(blob, F.lit(w))
    return out


def name_score(fields: list[Column], word: str) -> Column:
    """0 where a field begins with the word, 1 where one contains it, else 2."""
    begins, holds = F.lit(False), F.lit(False)
    for f in fields:
        begins, holds = begins | F.startswith(f, F.lit(word)), holds | F.contains(f, F.lit(word))
    return F.when(begins, 0).when(holds, 1).otherwise(2)


def code_score(codes: Column, word: str) -> Column:
    """Q04: 0 equal, 1 beginning, 2 containing, 3 none."""
    any_ = lambda f: F.exists(codes, f)
    return F.when(any_(lambda c: c == word), 0).when(any_(lambda c: F.startswith(c, F.lit(word))), 1).when(any_(lambda c: F.contains(c, F.lit(word))), 2).otherwise(3)


def ranked(hits: DataFrame, order: list[Column], cap: int | None) -> DataFrame:
    """The first cap hits, and in total how many there were before the cap."""
    total = hits.agg(F.count("*")).scalar()
    top = hits.orderBy(*order)
    return (top.limit(cap) if cap else top).withColumn("total", total)


def search_names(df: DataFrame, fields: list[str], words: list[str], order: list[str], cap: int | None = 200) -> DataFrame:
    """Q02, Q03, Q07, Q08: fields are normalised already. No words find nothing."""
    if not words:
        return df.where(F.lit(False)).withColumn("score", F.lit(0)).withColumn("total", F.lit(0).cast("long"))
    hits = df.where(holds_all(F.concat_ws(" ", *fields), words)).withColumn("score", name_score([F.col(f) for f in fields[:2]], words[0]))
    return ranked(hits, [F.col("score"), *map(F.col, order)], cap)


def search_codes(df: DataFrame, codes: str, blob: Column, words: list[tuple[str, str]], order: list[str], cap: int = 200) -> DataFrame:
    """Q04: each word, as (code form, name form), must be in a code or in the blob."""
    if not words:
        return df.where(F.lit(False)).withColumn("score", F.lit(0)).withColumn("total", F.lit(0).cast("long"))
    def held(code: str, name: str) -> Column:
        return F.exists(codes, lambda c: F.contains(c, F.lit(code))) | F.contains(blob, F.lit(name))

    found = F.lit(True)
    for code, name in words:
        found = found & held(code, name)
    hits = df.where(found).withColumn("score", code_score(F.col(codes), words[0][0]))
    return ranked(hits, [F.col("score"), *map(F.col, order)], cap)


def search_grouped(df: DataFrame, fields: list[str], words: list[str], group: str, name: str, cap: int = 100) -> DataFrame:
    """Q05, Q06: hits of one content as one group with its least score, size and first name."""
    if not words:
        return df.where(F.lit(False)).groupBy(group).agg(F.min(F.lit(0)).alias("score"), F.count("*").alias("size"), F.min(name).alias("first"))
    hits = df.where(holds_all(F.concat_ws(" ", *fields), words)).withColumn("score", name_score([F.col(f) for f in fields[:2]], words[0]))
    groups = hits.groupBy(group).agg(F.min("score").alias("score"), F.count("*").alias("size"), F.min_by(name, F.struct("score", name)).alias("first"))
    return groups.orderBy("score", F.desc("size"), "first", group).limit(cap)


def search_updates(df: DataFrame, fields: list[str], words: list[str], order: list[Column], cap: int = 300) -> DataFrame:
    """Q01: rows whose fields, joined by spaces, hold all words in the form of the update page, in the data's order; no words find all."""
    blob = watch_form(nfkc(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])))
    return ranked(df.where(holds_all(blob, [w.lower() for w in map(_nfkc, words)])) if words else df, order, cap)


def _nfkc(word: str) -> str:
    return unicodedata.normalize("NFKC", word)
