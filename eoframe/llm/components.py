"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe.llm.tables import materialize


def _settled(links: DataFrame) -> bool:
    """Whether every larger end has one link and no smaller end is linked further: each component is a star around its least."""
    ends = links.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    further = links.join(ends.select(F.col("a").alias("b")), "b", "left_semi")
    return ends.where("n > 1").select("a").union(further.select("b")).limit(1).count() == 0


def connected(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long). Returns node, root for every node of an edge between two nodes; root is the component's least.

    Every round links each node's larger neighbours, then its smaller ones, to its least neighbour; rounds go on until all
    components are stars, which takes about the logarithm of the longest path. Each round's table is written, so none is computed twice. The
    minimum per node is taken before rows meet, and a node with many links is joined from two tables, so Spark can split it.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = materialize(edges.where("a <> b").select(a, b).distinct(), "links")  # a > b
    while not _settled(now):
        both = now.union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        least = materialize(least, "least")
        large = now.select(F.col("b").alias("u"), F.col("a").alias("v"))  # the larger neighbours of u
        large = large.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "links")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), "least")
        small = large.withColumnRenamed("a", "u").join(least, "u").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "links")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
