"""Reproducible choice: order rows by a keyed hash, never by partition order or ``rand``.

The reference draws with seeded generators whose streams cannot be reproduced in parallel. Here the *counts and strata*
are kept and the draw becomes "the first k keys by md5(seed:key), ties by key".

No operator sorts or even shuffles the wide rows for that. A draw needs one number per stratum: the (hash, key) pair at
rank k, the *cut*. It is found from the key column alone:

1. the first hex digits of the hash are a range bucket (bucket order is hash order); rows per (stratum, bucket) are
   counted with map-side combine;
2. a running sum over that small table shows which bucket holds rank k;
3. only that bucket's keys are ranked, which gives the cut.

The full rows are then kept or labelled by comparing (hash, key) with the cut: a projection. A stratum holding a third
of all rows costs the same three narrow passes as any other, and no task ever sees more than one bucket of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eoframe.session import materialize

_H, _B, _K = "__hash", "__bucket", "__key"


def hash_key(seed: int | str, *cols: Column | str) -> Column:
    """md5(seed:key), the sort key of every sampling operator."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat(F.lit(f"{seed}:"), *[p.cast("string") for p in parts]))


def _null_safe(left: DataFrame, right: DataFrame, by: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[prefix + c]) for c in by])


def _bucketed(df: DataFrame, seed: int | str, key: str, by: list[str], digits: int) -> tuple[DataFrame, DataFrame]:
    keys = df.select(*by, F.col(key).alias(_K), hash_key(seed, key).alias(_H)).withColumn(
        _B, F.substring(_H, 1, digits)
    )
    counts = keys.groupBy(*by, _B).agg(F.count(F.lit(1)).alias("__n"))
    running = W.partitionBy(*by).orderBy(_B).rowsBetween(W.unboundedPreceding, 0)
    return keys, counts.withColumn("__end", F.sum("__n").over(running)).withColumn(
        "__start", F.col("__end") - F.col("__n")
    )


def _rank_in_buckets(keys: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """Ranks of the keys that lie in the wanted buckets."""
    small = wanted.select(*[F.col(c).alias("__j_" + c) for c in [*by, _B]], "__start", "__cut")
    hit = keys.join(small, _null_safe(keys, small, [*by, _B], "__j_"))
    inside = W.partitionBy(*by, _B, "__cut").orderBy(_H, _K)
    return hit.withColumn("__rank", F.row_number().over(inside) + F.col("__start"))


def cut_at(df: DataFrame, seed: int | str, key: str, rank: Column, digits: int = 3) -> Column:
    """struct(hash, key) of the row with this 1-based rank, as a scalar subquery; null when there are fewer rows."""
    keys, buckets = _bucketed(df, seed, key, [], digits)
    wanted = buckets.withColumn("__cut", rank).filter(
        (F.col("__start") < F.col("__cut")) & (F.col("__cut") <= F.col("__end"))
    )
    return (
        _rank_in_buckets(keys, F.broadcast(wanted), [])  # one row: the bucket holding the rank
        .filter(F.col("__rank") == F.col("__cut"))
        .agg(F.min(F.struct(F.col(_H).alias("h"), F.col(_K).alias("k"))).alias("cut"))
        .scalar()
    )


def _position(seed: int | str, key: str) -> Column:
    return F.struct(hash_key(seed, key).alias("h"), F.col(key).alias("k"))


def keep_first(df: DataFrame, seed: int | str, key: str, limit: Column | int, digits: int = 3) -> DataFrame:
    """The first ``limit`` rows by hash; everything when there are no more than that. ``key`` must be unique."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    cut = cut_at(df, seed, key, limit, digits)
    return df.filter((limit > 0) & (cut.isNull() | (_position(seed, key) <= cut)))


def keep_first_by(
    df: DataFrame, seed: int | str, key: str, by: list[str], limits: DataFrame, digits: int = 3
) -> DataFrame:
    """Like :func:`keep_first` inside strata. ``limits`` has the ``by`` columns and ``limit`` (null keeps all);
    strata absent from it are dropped."""
    keys, buckets = _bucketed(df, seed, key, by, digits)
    lim = limits.select(*[F.col(c).alias("__l_" + c) for c in by], F.col("limit").alias("__cut"))
    wanted = buckets.join(lim, _null_safe(buckets, lim, by, "__l_")).filter(
        (F.col("__start") < F.col("__cut")) & (F.col("__cut") <= F.col("__end"))
    )
    cuts = (
        _rank_in_buckets(keys, wanted, by)
        .filter(F.col("__rank") == F.col("__cut"))
        .select(*[F.col(c).alias("__c_" + c) for c in by], F.struct(F.col(_H).alias("h"), F.col(_K).alias("k")).alias("__at"))
    )
    small = limits.select(*by, "limit")
    per_stratum = small.join(cuts, _null_safe(small, cuts, by, "__c_"), "left").select(
        *[F.col(c).alias("__s_" + c) for c in by], "limit", "__at"
    )
    # Written, the table has a known size: Spark broadcasts it below its threshold, so the wide rows are not moved by stratum;
    # beyond that it joins them by sort and splits hot strata.
    per_stratum = materialize(per_stratum, "cuts")
    out = df.join(per_stratum, _null_safe(df, per_stratum, by, "__s_"))
    keep = F.col("limit").isNull() | (
        (F.col("limit") > 0) & (F.col("__at").isNull() | (_position(seed, key) <= F.col("__at")))
    )
    return out.filter(keep).select(*[df[c] for c in df.columns])


def split_at(
    df: DataFrame, seed: int | str, key: str, sizes: list[tuple[str, Column]], rest: str, out: str = "split",
    digits: int = 3,
) -> DataFrame:
    """Label rows in hash order: the first ``sizes[0]`` rows, the next ``sizes[1]`` ..., all others ``rest``."""
    label, upto = F, F.lit(0)
    for name, size in sizes:
        upto = upto + size
        cut = cut_at(df, seed, key, upto, digits)
        # no row at that rank: either nothing is wanted (upto is 0) or every row lies before it
        label = label.when((upto > 0) & (cut.isNull() | (_position(seed, key) <= cut)), F.lit(name))
    return df.withColumn(out, label.otherwise(F.lit(rest)))


def first_k_per_key(
    df: DataFrame, seed: int | str, by: list[str], key: str | Column, k: int, out: str = "rank"
) -> DataFrame:
    """The first k rows per group for a small constant k.

    Spark limits each group to k rows on the map side (window group limit), so a hot group never travels whole.
    """
    key_col = F.col(key) if isinstance(key, str) else key
    w = W.partitionBy(*by).orderBy(hash_key(seed, key_col), key_col)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def count_of(df: DataFrame) -> Column:
    """Row count of a frame as a scalar subquery (a one-row broadcast, no cross join)."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def hash_index(seed: int | str, n: Column | int, *cols: Column | str) -> Column:
    """0-based choice among n by the first byte of the keyed hash."""
    h, digits = hash_key(seed, *cols), F.lit("0123456789abcdef")
    byte = (F.instr(digits, F.substring(h, 1, 1)) - 1) * 16 + F.instr(digits, F.substring(h, 2, 1)) - 1
    return byte % (F.lit(n) if isinstance(n, int) else n)
