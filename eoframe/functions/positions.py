"""Places of rows in an order, counted over ranges instead of in one long task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eoframe.session import materialize

#: Columns that tell where a file's row stands, in their order.
FILE_ORDER = ["__file", "__block", "__row"]


def with_positions(df: DataFrame, order: list[str], groups: list[str] | None = None, name: str = "pos") -> DataFrame:
    """Adds the number of rows that come before in ``order`` (nulls first), within ``groups``.

    Rows are range partitioned and written once; each range counts its own, and the counts of whole ranges (one row per range and
    group) are summed. So no task sorts more than a range, however many rows a group has. Rows with equal keys may come in any
    order among themselves, but each place is given once.
    """
    groups = groups or []
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [F.col(c).asc_nulls_first() for c in [*groups, *order]]
    ranged = materialize(df.repartitionByRange(parts, *keys).withColumn("__range", F.spark_partition_id()), "ranges")
    whole = ranged.groupBy("__range", *groups).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(
        F.col("__range").alias("__r"), *[F.col(c).alias(f"__g_{c}") for c in groups],
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
    )
    same = F.col("__range") == F.col("__r")
    for c in groups:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    inside = Window.partitionBy("__range", *groups).orderBy(*keys)
    placed = ranged.join(before, same).withColumn(name, F.col("__before") + F.row_number().over(inside) - 1)
    return placed.select(*df.columns, name)


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows that come before in ``order`` (a column without repeats), counted over ranges."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = materialize(df.repartitionByRange(parts, order).withColumn("__range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    whole = ranged.groupBy(F.col("__range").alias("__r")).agg(F.sum(value).alias("__s"))
    before = whole.select("__r", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("__before") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return ranged.join(before, F.col("__range") == F.col("__r")).withColumn(name, total).select(*df.columns, name)


def file_rows(df: DataFrame) -> DataFrame:
    """Rows just read from files, with ``FILE_ORDER``: file, start of the block and running number of the row within its task.

    A block is read in order by one task, so these three order the rows as the files (by path) hold them.
    """
    place = F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")
    return df.select("*", *place, F.monotonically_increasing_id().alias("__row"))


def in_file_order(df: DataFrame, name: str = "pos") -> DataFrame:
    """The rows of a file scan with their places over all files, from 0.

    A block's rows have running numbers without a gap, so only blocks are counted and summed (one row each); the rows, written once
    since another scan may number them otherwise, are neither sorted nor shuffled.
    """
    rows = materialize(file_rows(df), "file-rows")
    blocks = rows.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    earlier = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("__file", "__block", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__before"))
    placed = rows.join(before, ["__file", "__block"]).withColumn(name, F.col("__before") + F.col("__row"))
    return placed.select(*df.columns, name)
