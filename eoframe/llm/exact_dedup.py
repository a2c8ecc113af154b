"""Exact deduplication against a persistent index of text digests, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eoframe.llm.tables import free_name, materialize, shared_dir

#: A group of copies is joined back in this many parts.
SALTS = 32


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


class DigestIndex:
    """One row per distinct text ever added: ``digest`` (SHA-256 of the UTF-8 text, lowercase hex), ``keep_id`` and the ``batch`` that
    brought it.

    The table is bucketed and sorted by digest, so a batch meets it in a sort-merge anti join that moves only the batch. Its
    files lie in a folder all executors reach; ``append`` adds files, it never rewrites any. One job at a time adds to it. Give ``path`` and ``name`` to go on
    with an index of an earlier session.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, name: str | None = None, buckets: int = 32):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or shared_dir(spark, "digest-index")
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"create table {self.name} (digest string, keep_id bigint, batch string) using parquet "
                f"clustered by (digest) sorted by (digest) into {buckets} buckets location '{self.path}'"
            )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds (digest, keep_id) rows of a batch, one writer per bucket."""
        rows = groups.select("digest", F.col("keep_id").cast("bigint").alias("keep_id"), F.lit(batch).alias("batch"))
        rows = rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        rows.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def add_batch(
    index: DigestIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None
) -> DataFrame:
    """Adds a batch to the index and says for each of its rows whether it stays.

    Returns doc_id, keep_id, group_size (rows of this batch with that text), kept, text_sha256, one row per input row. Of equal
    texts the row with the largest id stays; a text that the index held before keeps its earlier row, and the batch's rows go.
    ``batch`` names the batch: run again under its name (after a failure, say), it finds its own texts in the index, adds only what
    is missing and gives the same answer. Without a name every call is a batch of its own.

    A null text equals the empty one. A null id ranks below every number. Rows that repeat id and text stay once. An empty
    batch adds nothing. Other columns of the batch play no part.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))
    rows = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), "digests")
    parts = rows.groupBy("digest", "salt").agg(F.max("doc_id").alias("top"), F.sum("copies").alias("n"))
    groups = parts.groupBy("digest").agg(
        F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts")
    )
    groups = materialize(groups, "digest-groups")
    batch = batch or uuid.uuid4().hex
    fresh = groups.hint("merge").join(index.table().select("digest"), "digest", "left_anti")
    index.append(materialize(fresh.select("digest", "keep_id"), "digest-new"), batch)
    # now every digest of the batch is in the index, with the batch that brought it
    held = index.table().select("digest", F.col("keep_id").alias("stays"), (F.col("batch") == batch).alias("is_new"))
    marked = groups.join(held, "digest")
    marked = marked.select("digest", F.explode("salts").alias("salt"), "stays", "group_size", "is_new")
    out = rows.join(marked, ["digest", "salt"])
    first = F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("stays"))
    return out.select(
        "doc_id",
        F.col("stays").alias("keep_id"),
        "group_size",
        F.explode(F.transform(F.sequence(F.lit(1), F.col("copies").cast("int")), lambda i: first & (i == 1))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat an id and its text one stays."""
    decisions = add_batch(index or DigestIndex(docs.sparkSession), docs).where("kept")
    other_id, other_digest = free_name(docs, "_id"), free_name(docs, "_sha")
    digest, copy = free_name(docs, "_digest"), free_name(docs, "_copy")
    stay = decisions.select(F.col("doc_id").alias(other_id), F.col("text_sha256").alias(other_digest))
    rows = docs.withColumn(digest, text_digest(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.col(digest) == F.col(other_digest))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    repeats = Window.partitionBy("doc_id", digest).orderBy(F.xxhash64(*others) if others else F.lit(0))
    once = rows.join(stay, same, "left_semi").withColumn(copy, F.row_number().over(repeats))
    return once.where(F.col(copy) == 1).select(*docs.columns)
