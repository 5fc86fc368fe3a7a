"""Numbers of rows in an order, without one task for all of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.sources.tables import written


def numbered_rows(df: DataFrame, order: list[str | Column], into: str, freed: bool = False) -> tuple[DataFrame, int]:
    """The rows, in a written table, numbered from 0 in an order; and how many there are.

    The order is Spark's sort by ranges; sizes of the ranges come to the driver, one line for each.
    """
    ordered = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered", freed)
    sizes = sorted(ordered.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.cumsum([0, *(r.n for r in sizes)])
    offsets = df.sparkSession.createDataFrame([(r.part, int(b)) for r, b in zip(sizes, before, strict=False)], "__part long, __before long")
    low = F.col("__at").bitwiseAND((1 << 33) - 1)
    out = ordered.join(F.broadcast(offsets), F.shiftright("__at", 33) == F.col("__part"))
    return out.select(*df.columns, (F.col("__before") + low).alias(into)), int(before[-1])
