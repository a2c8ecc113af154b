"""Temporal pairs of patches at one location and the change between their label sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe.functions import text
from eoframe.functions.ranking import count_of, keep_first
from eoframe.operators.annotations import label_sets
from eoframe.operators.sampling import split_rows
from eoframe.session import materialize

BLOCK = 2000


def parse_patch_id(df: DataFrame, col: str = "patch_id") -> DataFrame:
    pid = F.col(col)
    return df.withColumns(
        {
            "date_str": text.patch_date_str(pid),
            "date": text.patch_date(pid),
            "tile": text.patch_tile(pid),
            "pixel_x": text.patch_x(pid),
            "pixel_y": text.patch_y(pid),
            "location_key": text.location_key(pid),
        }
    )


def temporal_pairs(patches: DataFrame, carry: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Every pair of patches of one location with different dates, earlier first. ``carry`` columns come along as
    ``<name>_t1`` and ``<name>_t2``.

    The result itself holds all those pairs, so the work is spread, not cut: every location is laid out as a grid of
    ceil(patches / block) rows and columns. A patch gets a row and a column by hash, is repeated along the other axis, and
    every cell of the grid joins about block x block patches in its own task; ``block`` is the size of a task.
    """
    carry = carry or []
    cols = ["patch_id", "location_key", "date_str", "date", "tile", "pixel_x", "pixel_y", *carry]
    left, right = _grid(patches.select(*cols), "patch_id", block)

    def side(df: DataFrame, n: str) -> DataFrame:
        keep = ["patch_id", "date_str", "date", "tile", "pixel_x", "pixel_y", *carry]
        return df.select("location_key", "__row", "__col", *[F.col(c).alias(f"{c}_t{n}") for c in keep])

    joined = side(left, "1").join(side(right, "2"), ["location_key", "__row", "__col"])
    pairs = joined.filter(F.col("date_str_t1") < F.col("date_str_t2"))
    return pairs.select(
        "patch_id_t1", "patch_id_t2",
        F.col("date_str_t1").alias("date_t1"), F.col("date_str_t2").alias("date_t2"),
        gap_days(F.col("date_t1"), F.col("date_t2")).alias("temporal_gap_days"),
        F.col("tile_t1").alias("tile"), F.col("pixel_x_t1").alias("pixel_x"), F.col("pixel_y_t1").alias("pixel_y"),
        "location_key", *[f"{c}_t{n}" for c in carry for n in (1, 2)],
    )


def _grid(rows: DataFrame, key: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self join on location_key, with the grid cell (__row, __col) as a further join key."""
    cells = rows.groupBy("location_key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__cells"))
    laid = rows.join(cells, "location_key")
    own = F.pmod(F.hash(key), F.col("__cells"))
    others = F.explode(F.sequence(F.lit(0), F.col("__cells") - 1))
    return (
        laid.withColumn("__row", own).withColumn("__col", others).drop("__cells"),
        laid.withColumn("__col", own).withColumn("__row", others).drop("__cells"),
    )


def gap_days(first: Column, second: Column) -> Column:
    """Days between two dates, 0 when one is unknown."""
    return F.coalesce(F.abs(F.datediff(second, first)), F.lit(0))


def label_change(a: Column, b: Column) -> Column:
    """Change between two label sets. Two empty sets are unchanged, yet their similarity is 0."""
    added, removed = F.array_except(b, a), F.array_except(a, b)
    common = F.array_intersect(a, b)
    n = F.size(added) + F.size(removed)
    kind = (
        F.when(n == 0, F.lit("no_change"))
        .when((F.size(added) > 0) & (F.size(removed) > 0), F.lit("land_use_transition"))
        .when(F.size(removed) > 0, F.lit("land_cover_loss"))
        .otherwise(F.lit("land_cover_gain"))
    )
    return F.struct(
        (n > 0).cast("int").alias("change_label"), kind.alias("change_type"),
        F.sort_array(added).alias("labels_added"), F.sort_array(removed).alias("labels_removed"),
        F.sort_array(common).alias("labels_common"),
        F.round(F.size(common) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), 4).alias("jaccard_similarity"),
        n.alias("n_changes"),
    )


def with_labels(patches: DataFrame, ann: DataFrame) -> DataFrame:
    """Label arrays are attached before pairing, so each is built once and only arrays travel."""
    empty = F.array().cast("array<string>")
    return patches.join(label_sets(ann), "patch_id", "left").withColumn("labels", F.coalesce("labels", empty))


def changed_pairs(ann: DataFrame, cached: DataFrame) -> DataFrame:
    located = with_labels(parse_patch_id(cached.select("patch_id")), ann)
    pairs = temporal_pairs(located, ["labels"])
    return pairs.withColumn("c", label_change(F.col("labels_t1"), F.col("labels_t2"))).select(
        F.col("patch_id_t1").alias("patch_t1"), F.col("patch_id_t2").alias("patch_t2"), "date_t1", "date_t2",
        "temporal_gap_days", "tile", "pixel_x", "pixel_y", "location_key", "c.change_label", "c.change_type",
        "c.labels_added", "c.labels_removed", "c.jaccard_similarity", "c.n_changes",
    )


def balance_self_pairs(ann: DataFrame, patches: DataFrame, seed: int) -> DataFrame:
    """Self pairs (a patch with itself, similarity 1) until unchanged pairs match changed ones or patches run out. The real
    pairs are counted by weight, not listed."""
    return self_pairs(pair_weights(ann, patches), patches, seed)


def self_pairs(weights: DataFrame, patches: DataFrame, seed: int) -> DataFrame:
    """As many self pairs as there are more changed than unchanged pairs in (change_type, weight), at most one per patch."""
    changed = F.when(F.col("change_type") == "no_change", -F.col("weight")).otherwise(F.col("weight"))
    tally = materialize(weights.agg(F.greatest(F.lit(0), F.sum(changed)).alias("n")), "pair-tally").scalar()
    chosen = keep_first(parse_patch_id(patches.select("patch_id")), seed, "patch_id", F.coalesce(tally, F.lit(0)))
    none = F.array().cast("array<string>")
    return chosen.select(
        F.col("patch_id").alias("patch_t1"), F.col("patch_id").alias("patch_t2"),
        F.col("date_str").alias("date_t1"), F.col("date_str").alias("date_t2"),
        F.lit(0).alias("temporal_gap_days"), "tile", "pixel_x", "pixel_y", "location_key",
        F.lit(0).alias("change_label"), F.lit("no_change_self").alias("change_type"),
        none.alias("labels_added"), none.alias("labels_removed"),
        F.lit(1.0).alias("jaccard_similarity"), F.lit(0).alias("n_changes"),
    )


def build_temporal_pairs(ann: DataFrame, cached: DataFrame, seed: int) -> DataFrame:
    """Real pairs, balancing self pairs, then the 70/15/15 split of pairs."""
    patches = cached.select("patch_id").distinct()
    # The real pairs are written once: they give the tally of the self pairs, two cuts and the output.
    real = materialize(changed_pairs(ann, patches), "temporal-pairs")
    added = materialize(self_pairs(real.select("change_type", F.lit(1).alias("weight")), patches, seed), "self-pairs")
    everything = real.unionByName(added).withColumn("pair_key", F.concat_ws("|", "patch_t1", "patch_t2"))
    return split_rows(everything, seed, "pair_key", [("train", 0.7), ("val", 0.15)], "test")


def pair_weights(ann: DataFrame, cached: DataFrame, block: int = BLOCK) -> DataFrame:
    """Change type and gap of all pairs with their number, without listing the pairs.

    Patches of one location, date and label set behave alike, so they are counted first and the counts are paired:
    what is joined is bounded by dates and label sets of a location, however many patches share them, and a location with
    many of them is laid out as a grid.
    """
    located = with_labels(parse_patch_id(cached.select("patch_id").distinct()), ann)
    counted = located.groupBy("location_key", "date_str", "date", "labels").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("cell_key", F.concat_ws("|", F.col("date_str"), F.to_json("labels")))
    sides = _grid(counted, "cell_key", block)
    a, b = [
        s.select("location_key", "__row", "__col", *[F.col(c).alias(f"{c}_{i}") for c in ("date_str", "date", "labels", "n")])
        for i, s in enumerate(sides, 1)
    ]
    pairs = a.join(b, ["location_key", "__row", "__col"]).filter(F.col("date_str_1") < F.col("date_str_2"))
    return pairs.select(
        label_change(F.col("labels_1"), F.col("labels_2"))["change_type"].alias("change_type"),
        gap_days(F.col("date_1"), F.col("date_2")).alias("gap"),
        (F.col("n_1") * F.col("n_2")).alias("weight"),
    )


def gap_stats(weights: DataFrame) -> DataFrame:
    """Gap range, mean and number of changed pairs by change type."""
    changed = weights.filter(F.col("change_type") != "no_change")
    return changed.groupBy("change_type").agg(
        F.sum("weight").alias("n_pairs"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"),
        (F.sum(F.col("gap") * F.col("weight")) / F.sum("weight")).alias("mean_gap"),
    )
