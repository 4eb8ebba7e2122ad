"""Connected components of an edge table by alternating star contractions.

Every round joins each edge to the least neighbour of its end; no group is collected,
and the edges are checkpointed so that a lost executor does not replay the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltmap.session import cut


def _least(edges: DataFrame) -> DataFrame:
    """Edges with m, the least neighbour of a: one exchange, where a join with the minima would take two."""
    return edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
    return _least(edges).select(F.inline(ends))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the least node reached.

    Self loops, repeated and reversed edges are allowed; rows with a null end are left out.
    """
    edges = cut(
        edges.filter("a IS NOT NULL AND b IS NOT NULL")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    loops = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("label"))
    edges = edges.filter("a > b")
    parts = edges.sparkSession.sparkContext.defaultParallelism
    seen = None
    while True:
        edges = cut(_small(_large(edges)).filter("a > b").distinct())
        mark = edges.coalesce(parts).agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if mark == seen:
            break
        seen = mark
    roots = edges.select(F.col("b").alias("node")).distinct()
    return (
        edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        .unionByName(roots.select("node", F.col("node").alias("label")))
        .unionByName(loops)
        .groupBy("node")
        .agg(F.min("label").alias("label"))
    )
