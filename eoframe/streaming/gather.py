"""Gather: hold the items of a key until all are there, emit the set once, forget it.

A batch is an ordinary table, so sets that come whole within it are completed by aggregation, whatever their number. Only what
is left over is state: a table of held items and, where a set may not come again, of keys that are done. Each batch reads the
state of the batch before and writes its own, so a repeated batch finds the same state, and both age out after ``ttl_ms``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eoframe.session import shared_dir
from eoframe.streaming.runtime import delete, read_written

#: The place of a held item: before every item of the batch.
HELD = -(2**63)


@dataclass(frozen=True)
class SetRule:
    """What makes a set of a key: the listed ``items`` (others are ignored), or as many different ones as the column ``items`` says.

    Items come in ``order`` within a batch, batches in theirs; a repeated item replaces the held payload until the set is whole.
    After that, later items of the key are skipped (``reemit=False``), or begin a new set. Held items and the keys of whole sets are
    kept for ``ttl_ms`` at least; a key that is incomplete for longer is emitted as such and forgotten. None keeps them for good.
    """

    key: str
    item: str
    payload: str
    order: str
    items: list[str] | str
    reemit: bool = False
    ttl_ms: int | None = None

    def listed(self, members: DataFrame) -> DataFrame:
        counted = isinstance(self.items, str)
        known = F.lit(True) if counted else F.col(self.item).isin(self.items)
        expected = F.col(self.items).cast("int") if counted else F.lit(len(self.items))
        return members.where(known & (F.col(self.key) != "")).select(
            F.col(self.key).alias("key"), F.col(self.item).alias("item"), F.col(self.payload).alias("payload"),
            F.col(self.order).cast("bigint").alias("pos"), expected.alias("expected"),
        )


ITEM = ["key", "item", "payload", "expected", "since"]


def per_item(rows: DataFrame) -> DataFrame:
    """One row per key and item: its first and last place and its latest payload. Combined before rows meet."""
    return rows.groupBy("key", "item").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.max_by("payload", "pos").alias("payload"),
        F.max("expected").alias("expected"), F.min("since").alias("since"),
    )


def with_completion(items: DataFrame, counted: bool) -> DataFrame:
    """Adds ``completed_at``, the place of the item that completes its key's first set, null for an incomplete key."""
    key = Window.partitionBy("key")
    if counted:  # more items than a set needs may be there
        items = items.withColumn("n", F.row_number().over(key.orderBy("first", "item")))
        at = F.min(F.when(F.col("n") >= F.col("expected"), F.col("first"))).over(key)
    else:
        items = items.withColumn("n", F.count(F.lit(1)).over(key))
        at = F.when(F.col("n") == F.col("expected"), F.max("first").over(key))
    return items.withColumn("completed_at", at).drop("n")


def sets_of(items: DataFrame, status: str) -> DataFrame:
    """One row per key and ``completed_at`` with the payload of each item."""
    held = F.map_from_entries(F.collect_list(F.struct("item", "payload")))
    sets = items.groupBy("key", "completed_at").agg(held.alias("items"))
    return sets.select("key", F.lit(status).alias("status"), "completed_at", "items")


def split_sets(rows: DataFrame, rule: SetRule, cached: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(whole sets, items left) of rows (key, item, payload, pos, expected, since). ``cached`` gathers what to unpersist.

    A key has one set, or with ``reemit`` as many as its rows complete one after the other; each further set of a key within one
    batch takes one more round over what is left of such keys. Rows are read again only where an item was repeated after the set
    was whole.
    """
    items = with_completion(per_item(rows), isinstance(rule.items, str)).persist()
    cached.append(items)
    left, whole = items.where("completed_at is null").select(*ITEM), items.where("first <= completed_at")
    parts = whole.where("last <= completed_at").select("key", "item", "payload", "completed_at")
    again = whole.where("last > completed_at").select("key", "item", "completed_at")
    if not again.isEmpty():
        earlier = rows.select("key", "item", "payload", "pos").join(again, ["key", "item"]).where("pos <= completed_at")
        earlier = earlier.groupBy("key", "item", "completed_at").agg(F.max_by("payload", "pos").alias("payload"))
        parts = parts.unionByName(earlier)
    sets = sets_of(parts, "complete")
    over = items.where("last > completed_at").select("key", "completed_at").distinct()
    if rule.reemit and not over.isEmpty():
        later = rows.join(over, "key").where("pos > completed_at").select(*rows.columns).persist()
        cached.append(later)
        more, rest = split_sets(later, rule, cached)
        return sets.unionByName(more), left.unionByName(rest)
    return sets, left


def gather(
    members: DataFrame, rule: SetRule, sinks: Callable[[DataFrame], dict[str, DataFrame]] | None = None, purpose: str = "gather",
    folder: str | None = None, clock: Callable[[], float] = time.time,
) -> dict[str, DataFrame]:
    """Runs over everything available of a stream and returns the table ``sets`` (key, status, completed_at, items) and those of
    ``sinks``, which are computed from each batch's sets.

    ``folder`` holds the checkpoint, the tables and the state; started again with it, the stream goes on where it stopped. A batch
    that is repeated after a failure overwrites its own sub-folders, so nothing comes twice. State of batches before the last is
    deleted. ``clock`` gives seconds.
    """
    spark = members.sparkSession
    folder = folder or shared_dir(spark, purpose)
    listed = rule.listed(members)
    empty = spark.createDataFrame([], listed.schema).withColumn("since", F.lit(0).cast("bigint"))
    schemas = {"sets": sets_of(empty.withColumn("completed_at", F.col("pos")), "").schema}
    schemas |= {n: df.schema for n, df in (sinks(spark.createDataFrame([], schemas["sets"])) if sinks else {}).items()}
    held_schema, done_schema = empty.select(*ITEM).schema, "key string, since bigint"

    def write(batch: DataFrame, batch_id: int) -> None:
        now = int(clock() * 1000)
        before, own = (f"{folder}/state/batch={b}" for b in (batch_id - 1, batch_id))
        rows = batch.withColumn("since", F.lit(now).cast("bigint"))
        if batch_id:
            done = spark.read.schema(done_schema).parquet(f"{before}/done")
            held = spark.read.schema(held_schema).parquet(f"{before}/held").withColumn("pos", F.lit(HELD).cast("bigint"))
            rows = held.unionByName(rows.join(done.select("key"), "key", "left_anti"))
        else:
            done = spark.createDataFrame([], done_schema)
        cached = [rows.persist()]
        sets, kept = split_sets(rows, rule, cached)
        keys = sets.select("key")
        if rule.ttl_ms is not None:
            edge = now - rule.ttl_ms
            kept = kept.withColumn("begun", F.min("since").over(Window.partitionBy("key"))).persist()
            cached.append(kept)
            expired = kept.where(F.col("begun") <= edge).withColumn("completed_at", F.lit(-1).cast("bigint"))
            sets = sets.unionByName(sets_of(expired, "incomplete"))
            kept = kept.where(F.col("begun") > edge).select(*ITEM)
            done = done.where(F.col("since") > edge)
        if not rule.reemit:
            done = done.unionByName(keys.withColumn("since", F.lit(now).cast("bigint")))
        sets.write.mode("overwrite").parquet(f"{folder}/sets/batch={batch_id}")
        kept.write.mode("overwrite").parquet(f"{own}/held")
        done.write.mode("overwrite").parquet(f"{own}/done")
        made = spark.read.schema(schemas["sets"]).parquet(f"{folder}/sets/batch={batch_id}")
        for name, df in (sinks(made) if sinks else {}).items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        delete(spark, f"{folder}/state/batch={batch_id - 2}")
        for df in cached:
            df.unpersist()

    query = (
        listed.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return {name: read_written(spark, f"{folder}/{name}", schema) for name, schema in schemas.items()}


def skip_stored(stream: DataFrame, store: DataFrame, key: str = "patch_id") -> DataFrame:
    """Resume: members whose patch is stored already are dropped by a stream-static anti join."""
    return stream.join(store.select(key), key, "left_anti")
