"""Stratified samples, caps and splits with exact counts, drawn by keyed hash (see functions.ranking)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv
from eoframe.functions.positions import running_total
from eoframe.functions.ranking import (
    count_of, cut_at, first_k_per_key, hash_key, keep_first, keep_first_by, split_at,
)
from eoframe.operators.annotations import first_per_patch
from eoframe.session import materialize

# A draw reads its input three times (bucket counts, cut bucket, output). Where that input is the result of a scan of
# all annotations, the narrow (patch_id, country) table is written once to the shared folder, so the annotations are
# scanned once and a lost executor costs one re-read.


def _strata(patches: DataFrame, quota: Column) -> DataFrame:
    counts = patches.groupBy("country").agg(F.count(F.lit(1)).alias("c"))
    return counts.select("country", F.greatest(F.lit(1), quota.cast("bigint")).alias("limit"))


def sample_patches_v1(ann: DataFrame, n: int, seed: int) -> DataFrame:
    """Quota per country max(1, floor(n*c/T)), trimmed to n. Floors are not topped up, patches without a country are
    never drawn but count in T, and n >= T keeps every patch."""
    patches = materialize(first_per_patch(ann, ["country"]), "patch-country")
    total = count_of(patches)
    known = patches.filter(F.col("country").isNotNull())
    quotas = _strata(known, F.floor(F.lit(n) * F.col("c") / total))
    drawn = materialize(keep_first_by(known, seed, "patch_id", ["country"], quotas), "patch-draw")
    trimmed = keep_first(drawn, f"{seed}:trim", "patch_id", n)
    return trimmed.filter(total > n).union(patches.filter(total <= n))


def sample_patches_v2(ann: DataFrame, n: int, seed: int) -> DataFrame:
    """Quota max(1, floor((c/T)*n)), division first, then topped up to n from the rest; never trimmed, so it can
    exceed n. Patches without a country are a stratum of their own."""
    patches = materialize(first_per_patch(ann, ["country"], skip_nulls=False), "patch-country")
    total = count_of(patches)
    target = F.least(F.lit(n), total)
    quotas = _strata(patches, F.floor(F.col("c") / total * target))
    drawn = materialize(keep_first_by(patches, seed, "patch_id", ["country"], quotas), "patch-draw")
    return drawn.union(_top_up(patches, drawn, target, seed))


def _top_up(patches: DataFrame, drawn: DataFrame, target: Column, seed: int) -> DataFrame:
    rest = patches.join(drawn.select("patch_id"), "patch_id", "left_anti").select(*patches.columns)
    return keep_first(rest, f"{seed}:topup", "patch_id", target - count_of(drawn))


def sample_patches_v3(ann: DataFrame, cached: DataFrame, n: int, seed: int) -> DataFrame:
    """Without cached patches: quota as in v1 by country only, topped up, cut to n."""
    patches = first_per_patch(ann, ["country"]).join(cached.select("patch_id"), "patch_id", "left_anti")
    patches = materialize(patches.select("patch_id", "country"), "patch-country")
    total = count_of(patches)
    known = patches.filter(F.col("country").isNotNull())
    quotas = _strata(known, F.floor(F.lit(n) * F.col("c") / total))
    drawn = materialize(keep_first_by(known, seed, "patch_id", ["country"], quotas), "patch-draw")
    filled = materialize(drawn.union(_top_up(patches, drawn, F.lit(n), seed)), "patch-draw")
    chosen = keep_first(filled, f"{seed}:head", "patch_id", n)
    return chosen.filter(total > n).union(patches.filter(total <= n))


def cap_per_type(df: DataFrame, seed: int, caps: dict[str, int | None] | None = None, key: str = "ann_id") -> DataFrame:
    """At most the cap of each type; types without a cap are kept whole, rows without a type are dropped."""
    caps = fv.TYPE_CAPS if caps is None else caps
    table = df.sparkSession.createDataFrame(list(caps.items()), "type string, cap bigint")
    typed = df.filter(F.col("type").isNotNull())
    limits = (
        typed.select("type").distinct().join(F.broadcast(table), "type", "left").select("type", F.col("cap").alias("limit"))
    )
    return keep_first_by(typed, seed, key, ["type"], limits)


def split_by_patch(
    entries: DataFrame, frac: float, seed: int, floor: int = 1, universe: DataFrame | None = None
) -> DataFrame:
    """train/val by patch, so no patch is on both sides: val gets max(floor, int(n*frac)) patches.

    ``universe`` (patch_id) ranks the selected patches instead of those having entries, and entries of other patches are
    left out. The label is a function of the patch id and one cut, so entries are labelled without a join.
    """
    ids = entries.select(F.col("image").alias("patch_id")) if universe is None else universe.select("patch_id")
    if universe is not None:
        entries = entries.join(ids, F.col("image") == F.col("patch_id"), "left_semi")
    ids = ids.distinct()
    size = F.greatest(F.lit(floor), F.floor(count_of(ids) * F.lit(frac)).cast("bigint"))
    cut = cut_at(ids, seed, "patch_id", size)
    at = F.struct(hash_key(seed, F.col("image")).alias("h"), F.col("image").alias("k"))
    return entries.withColumn(
        "split", F.when(cut.isNull() | (at <= cut), F.lit("val")).otherwise(F.lit("train"))
    )


def split_rows(
    df: DataFrame, seed: int, key: str, fractions: list[tuple[str, float]], rest: str, floor: int = 0
) -> DataFrame:
    """Row-level split: parts of int(n*fraction) rows in hash order, the others to ``rest``. ``floor`` is the least
    size of the first part. Passing a location as ``key`` requires one row per key; see ``split_groups``."""
    n = count_of(df)
    sizes = [
        (name, F.greatest(F.lit(floor if i == 0 else 0), F.floor(n * F.lit(f)).cast("bigint")))
        for i, (name, f) in enumerate(fractions)
    ]
    return split_at(df, seed, key, sizes, rest)


def split_groups(df: DataFrame, seed: int, by: str, fractions: list[tuple[str, float]], rest: str) -> DataFrame:
    """Leak-free option: split the distinct groups and give every row its group's side."""
    other = f"__{by}"
    sides = split_rows(df.select(F.col(by).alias(other)).distinct(), seed, other, fractions, rest)
    return df.join(sides, F.col(by).eqNullSafe(F.col(other))).drop(other)


def cap_balanced(df: DataFrame, col: str, total: int, seed: int, key: str) -> DataFrame:
    """More than ``total`` rows: total // k of each category, not topped up. Otherwise everything."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("c"))
    n, k = count_of(df), count_of(counts)
    limit = F.when(n > total, F.floor(F.lit(total) / k).cast("bigint"))
    return keep_first_by(df, seed, key, [col], counts.select(col, limit.alias("limit")))


def sample_by_class(df: DataFrame, col: str, total: int, per: int, seed: int, key: str) -> DataFrame:
    """Same quota for each class: total // k // per."""
    classes = df.select(col).distinct()
    limit = F.floor(F.floor(F.lit(total) / F.greatest(count_of(classes), F.lit(1))) / per).cast("bigint")
    return keep_first_by(df, seed, key, [col], classes.select(col, limit.alias("limit")))


def sample_per_key(df: DataFrame, by: str, k: int, seed: int, key: str) -> DataFrame:
    return first_k_per_key(df, seed, [by], key, k)


def sample_keys(df: DataFrame, n: int, seed: int, key: str = "patch_id") -> DataFrame:
    """n keys by hash (a bounded top-n per task, merged), returned in key order."""
    return df.select(key).distinct().orderBy(hash_key(seed, key), key).limit(n).orderBy(key)


def first_keys(df: DataFrame, n: int, key: str = "patch_id") -> DataFrame:
    return df.select(key).distinct().orderBy(key).limit(n)


def sample_multilabel(labels: DataFrame, n: int, val: float, seed: int) -> DataFrame:
    """n patches, rarest label first and hash order among equals, then a val share. The reference's own rule is not
    published with its code; this rule is ours."""
    exploded = labels.select("patch_id", F.explode("labels").alias("label"))
    sizes = exploded.groupBy("label").agg(F.count(F.lit(1)).alias("class_size"))
    rarity = materialize(
        exploded.join(sizes, "label").groupBy("patch_id").agg(F.min("class_size").alias("rarity")), "patch-rarity"
    )
    per_rarity = rarity.groupBy("rarity").agg(F.count(F.lit(1)).alias("c"))
    # classes are few, but nothing bounds them: their running total is taken over ranges
    limits = running_total(per_rarity, "rarity", "c", "before").select(
        "rarity", F.greatest(F.lit(0), F.least(F.col("c"), F.lit(n) - F.col("before"))).alias("limit")
    )
    chosen = materialize(keep_first_by(rarity, seed, "patch_id", ["rarity"], limits), "patch-draw")
    return split_rows(chosen, seed, "patch_id", [("val", val)], "train")


def stable_shuffle(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Output order by keyed hash: a range-partitioned sort, reproducible on any cluster."""
    return df.orderBy(hash_key(seed, key), key)
