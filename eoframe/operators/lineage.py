"""Lineage of provenance records as a graph: all ancestors of every record, in a logarithm of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe.session import materialize


def parent_links(records: DataFrame, key: str = "output_id", parents: str = "lineage_parent_ids") -> DataFrame:
    """(id, parent) of records that name their parents; repeated, null and empty names are dropped."""
    links = records.select(F.col(key).alias("id"), F.explode(parents).alias("parent"))
    return links.where((F.col("id") != "") & (F.col("parent") != "")).distinct()


def lineage_closure(links: DataFrame) -> DataFrame:
    """(id, ancestor, distance) for everything that a record derives from; ``links``: id, parent.

    A pair's distance is the length of the shortest chain. With all pairs up to a distance known, a round joins those at just this
    distance with all: a shortest chain up to twice as long passes such a record, so rounds are the logarithm of the longest shortest
    chain. A round's new pairs are those not known before; they are written once beside the others, which are not written again.
    Nothing is longer when no pair is at the full distance, so cycles end like all else (a record in a cycle is its own ancestor).
    """
    first = links.select("id", F.col("parent").alias("ancestor"), F.lit(1).cast("bigint").alias("distance")).distinct()
    known = ends = materialize(first, "lineage")
    reach = 1
    while not ends.isEmpty():
        up = known.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("further"), F.col("distance").alias("more"))
        longer = ends.join(up, "ancestor").select(
            "id", F.col("further").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance")
        )
        fresh = longer.groupBy("id", "ancestor").agg(F.min("distance").alias("distance"))
        fresh = materialize(fresh.join(known, ["id", "ancestor"], "left_anti"), "lineage")
        reach *= 2
        known, ends = known.unionByName(fresh), fresh.where(F.col("distance") == reach)
    return known


def lineage_summary(records: DataFrame, closure: DataFrame, key: str = "output_id") -> DataFrame:
    """Per record: number of ancestors, of those without parents of their own (sources) and of those that no record has; how far
    the furthest is; whether the record lies in a cycle."""
    ids = records.select(F.col(key).alias("ancestor"), F.lit(True).alias("there")).distinct()
    # every ancestor is someone's parent; the sources are written, so Spark knows their size and moves no pairs to meet a few
    nearest = closure.where(F.col("distance") == 1)
    sources = nearest.select("ancestor").distinct().join(nearest.select(F.col("id").alias("ancestor")), "ancestor", "left_anti")
    sources = sources.join(ids, "ancestor", "left").select("ancestor", F.col("there").isNull().alias("unknown"))
    marked = closure.join(materialize(sources, "lineage-sources"), "ancestor", "left")
    per = marked.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_ancestors"), F.count("unknown").alias("n_sources"),
        F.count_if("unknown").alias("n_unknown"), F.max("distance").alias("depth"),
        F.bool_or(F.col("id") == F.col("ancestor")).alias("in_cycle"),
    )
    zero = F.lit(0)
    return records.select(F.col(key).alias("id")).distinct().join(per, "id", "left").select(
        "id", *[F.coalesce(c, zero).alias(c) for c in ("n_ancestors", "n_sources", "n_unknown", "depth")],
        F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"),
    )
