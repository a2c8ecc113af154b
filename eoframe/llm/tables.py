"""Reading the given tables, written intermediates and distributed running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eoframe.session import materialize, shared_dir

__all__ = ["count_parts", "documents", "free_name", "materialize", "running_sums", "shared_dir", "table", "text_hash", "unit_hash"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def unit_hash(key: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 that depends on the key and the seed alone (48 bits of MD5). A null key is a key."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**48))


def text_hash(text: Column) -> Column:
    """Tells texts under one id apart (64 bits). A null text equals the empty one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def count_parts(rows: int, per_part: int) -> int:
    """How many parts hold ``rows`` at ``per_part`` each, at least one."""
    return max(1, -(-rows // per_part))


def running_sums(df: DataFrame, order: list[str], values: dict[str, str], groups: list[str] | None = None) -> DataFrame:
    """Adds, per value column, the sum over all rows that come before in ``order`` (within ``groups``), without one long task.

    ``values`` maps a column to the name of its running sum; ``order`` must tell rows apart for a repeatable result. Rows are
    range partitioned and written once, each range is summed, the sums of whole ranges (one row per range and group) are
    accumulated, and each range is then summed on its own. Rows with equal order keys may come in any order.
    """
    groups = groups or []
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
    kept = materialize(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    whole = kept.groupBy("_range", *groups).agg(*[F.sum(c).alias(f"_t_{c}") for c in values])
    earlier = Window.orderBy("_range") if not groups else Window.partitionBy(*groups).orderBy("_range")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select("_range", *groups, *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in values])
    offsets = offsets.select("_range", *[F.col(c).alias(f"_g_{c}") for c in groups], *[f"_o_{c}" for c in values])
    same = [kept["_range"] == offsets["_range"]] + [kept[c].eqNullSafe(offsets[f"_g_{c}"]) for c in groups]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    joined = kept.join(offsets, condition).drop(offsets["_range"])
    inside = Window.partitionBy("_range", *groups).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = [
        (F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name) for c, name in values.items()
    ]
    return joined.select(*df.columns, *out)
