"""Connected components of a graph of ids, by alternating large and small stars.

Edges never leave the cluster. A node's least neighbour comes beside its edges by a window
where all edges fit one task, else by a join that doesn't put a hot node's edges in one. Each round is
written, so a lost executor repeats no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.storage import ONE_TASK, beside, discard, materialise_counted, tasks


def star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """Edges (a, b), a > b. Every node's neighbours (large: the greater ones, of all; else the smaller ones) go to the least of all."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    met = beside(near, ["u"], {"least": F.min("v")}, 2 * total, ONE_TASK).withColumn("m", F.least("least", "u"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array("v", "u")).alias("a"), F.col("m").alias("b"))
    return out.where("a > b")


def once(edges: DataFrame, most: int | None) -> DataFrame:
    """Distinct edges, in as many tasks as they are worth where their number, at most, is known and fits one task."""
    edges = edges.distinct()
    return edges if most is None or most > ONE_TASK else edges.coalesce(tasks(most))


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """(id, root) of all nodes of links (a, b) but the roots themselves, where root is the least id that a node reaches; most is the number of links, or more."""
    edges = once(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), most)
    before = written = None
    while True:
        edges, now = materialise_counted(edges, "edges", F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
        if written is not None:
            discard(written)
        written = edges
        if now.n == 0 or now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now
        edges = once(star(star(edges, now.n, large=True), now.n, large=False), now.n)  # stars give no more edges than they get
