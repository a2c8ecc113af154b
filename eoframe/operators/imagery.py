"""Imagery gathering: archive members, manifests, coverage, completeness and source resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv
from eoframe.functions import text
from eoframe.session import materialize


def parse_member_path(df: DataFrame, mode: str = "parent") -> DataFrame:
    path = F.col("path")
    return df.withColumns({"patch_id": text.member_patch(path, mode), "band": text.member_band(path, mode)})


def count_items(item: str, items: list[str]) -> Column:
    """Number of different listed items of a group, as bits of one number: a group is one row before it is shuffled, whatever its
    number of items (a distinct count would shuffle a row for each)."""
    return F.bit_count(F.coalesce(F.bit_or(_item_bit(item, items)), F.lit(0)))


def _item_bit(item: str, items: list[str]) -> Column:
    bits = F.when(F.col(item) == items[0], F.lit(1).cast("bigint"))
    for i, name in enumerate(items[1:], 1):
        bits = bits.when(F.col(item) == name, F.lit(1 << i).cast("bigint"))
    return bits


def gather_complete(members: DataFrame, key: str, item: str, payload: str, order: str, items: list[str]) -> DataFrame:
    """Groups of which every item arrived, with the payloads held at the moment the set became complete.

    Members arrive in ``order``; other items are ignored, a repeated item replaces the held payload until the set is
    complete, later repeats are skipped because the group is stored by then, and incomplete groups are not emitted.
    One aggregation with map-side combine: of each item the first and the last arrival and their number, so a group is one row before it
    is shuffled, however many members it has. These tell the payload held unless an item came three times or more and went on coming
    after completion; such groups, and only these, are joined with their members.
    """
    listed = members.filter(F.col(item).isin(items) & (F.col(key) != ""))
    hashed = F.xxhash64(key).alias("__hash")  # keys may begin alike; rows are sorted by the hash first
    at, aggregates = [F.when((F.col(item) == i) & F.col(order).isNotNull(), F.struct(order, payload)) for i in items], []
    for n, arrival in enumerate(at):
        aggregates += [F.min(arrival).alias(f"first{n}"), F.max(arrival).alias(f"last{n}"), F.count(arrival).alias(f"n{n}")]
    per_key = listed.groupBy(hashed, key).agg(count_items(item, items).alias("__found"), *aggregates)
    completed = F.greatest(*[F.col(f"first{n}")[order] for n in range(len(items))]) if len(items) > 1 else F.col("first0")[order]
    done = per_key.filter(F.col("__found") == len(items)).withColumn("completed_at", completed)
    open_yet = F.lit(False)
    held = []
    for n, name in enumerate(items):
        late = F.col(f"last{n}")[order] > F.col("completed_at")
        open_yet = open_yet | ((F.col(f"n{n}") > 2) & late)
        value = F.when(late, F.col(f"first{n}")[payload]).otherwise(F.col(f"last{n}")[payload])
        held.append(F.when(F.col(f"n{n}") > 0, F.struct(F.lit(name).alias(item), value.alias(payload))))
    told = done.select(key, "completed_at", F.sort_array(F.array_compact(F.array(*held))).alias("items"), open_yet.alias("open"))
    told = materialize(told, "gathered")
    settled = told.filter(~F.col("open")).drop("open")
    rest = told.filter("open").select(key, "completed_at")
    if rest.isEmpty():
        return settled
    last = listed.join(rest, key).filter(F.col(order) <= F.col("completed_at")).groupBy(key, "completed_at", item).agg(
        F.max_by(payload, order).alias(payload)
    )
    gathered = last.groupBy(key, "completed_at").agg(F.sort_array(F.collect_list(F.struct(item, payload))).alias("items"))
    return settled.unionByName(gathered)


def s1_s2_map(manifest: DataFrame, order: str) -> DataFrame:
    """Radar name to patch; empty names are skipped and the last patch wins a repeated name."""
    named = manifest.filter(F.coalesce("s1_name", F.lit("")) != "")
    return named.groupBy("s1_name").agg(F.max_by("patch_id", order).alias("patch_id"))


def resolve_sources(required: DataFrame, sources: dict[str, DataFrame], fallback: str = "synthetic") -> DataFrame:
    """First source (in the given order) that has each required patch. Availability is reduced to one row per patch
    before the join, so only patch ids and a small number travel."""
    names = list(sources)
    parts = [s.select("patch_id").withColumn("priority", F.lit(i)) for i, s in enumerate(sources.values())]
    best = parts[0]
    for p in parts[1:]:
        best = best.union(p)
    best = best.groupBy("patch_id").agg(F.min("priority").alias("priority"))
    labels = F.array(*[F.lit(n) for n in names])
    return required.select("patch_id").distinct().join(best, "patch_id", "left").select(
        "patch_id", F.coalesce(F.get(labels, F.col("priority")), F.lit(fallback)).alias("source")
    )


def coverage(required: DataFrame, cached: DataFrame) -> DataFrame:
    """Required, cached and covered patches. ``coverage_pct`` uses the intersection; ``raw_ratio_pct`` divides all
    cached by required and may exceed 100."""
    need = required.select("patch_id").distinct().withColumn("need", F.lit(1))
    have = cached.select("patch_id").distinct().withColumn("have", F.lit(1))
    counts = need.join(have, "patch_id", "full").agg(
        F.count("need").alias("required"), F.count("have").alias("cached"),
        F.count_if(F.col("need").isNotNull() & F.col("have").isNotNull()).alias("covered"),
    )

    def pct(part: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part) * 100.0, F.col("required")), F.lit(0.0))

    return counts.withColumns({"coverage_pct": pct("covered"), "raw_ratio_pct": pct("cached")})


def _store_status(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """store: patch_id, n_s2, n_s1, corrupt."""
    facts = store.select("patch_id", "n_s2", "n_s1", "corrupt").withColumn("found", F.lit(True))
    return manifest.select("patch_id").join(facts, "patch_id", "left").withColumns(
        {
            "found": F.coalesce("found", F.lit(False)),
            "readable": F.coalesce(~F.col("corrupt"), F.lit(False)),
            "s2_ok": F.coalesce(F.col("n_s2") == len(fv.PACKED_BANDS), F.lit(False)),
            "s1_ok": F.coalesce(F.col("n_s1") == len(fv.RADAR_CHANNELS), F.lit(False)),
        }
    )


def verify_store(manifest: DataFrame, store: DataFrame) -> DataFrame:
    c = F.col
    return _store_status(manifest, store).agg(
        F.count(F.lit(1)).alias("total_expected"),
        F.count_if("found").alias("found"),
        F.count_if(~c("found")).alias("missing"),
        F.count_if(c("readable") & c("s2_ok")).alias("has_s2"),
        F.count_if(c("readable") & c("s1_ok")).alias("has_s1"),
        F.count_if(c("readable") & c("s2_ok") & c("s1_ok")).alias("has_both"),
        F.count_if(c("found") & ~c("readable")).alias("corrupt"),
    )


def missing_patches(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """The missing list as rows: it grows with the manifest, so it is a table and not an array."""
    return manifest.select("patch_id").join(store.select("patch_id"), "patch_id", "left_anti")


def verify_pairs(manifest: DataFrame, s1: DataFrame, s2: DataFrame) -> DataFrame:
    """Pair report over (patch_id, s1_name), s1 (s1_name, channels, side, corrupt) and s2 (patch_id, bands, side,
    corrupt). The reference only describes it; a patch is counted under its first failing check, in column order."""
    joined = (
        manifest.select("patch_id", "s1_name", F.lit(True).alias("listed"))
        .join(s2.select("patch_id", "bands", F.col("side").alias("s2_side"), F.col("corrupt").alias("s2_bad"),
                        F.lit(True).alias("in_s2")), "patch_id", "full")
        .join(s1.select("s1_name", "channels", F.col("side").alias("s1_side"), F.col("corrupt").alias("s1_bad"),
                        F.lit(True).alias("in_s1")), "s1_name", "full")
    )
    c = F.col
    status = (
        F.when(c("listed").isNull(), F.lit("missing_metadata"))
        .when(c("in_s2").isNull(), F.lit("missing_s2"))
        .when(c("in_s1").isNull(), F.lit("missing_s1"))
        .when(c("s1_bad") | c("s2_bad"), F.lit("corrupt"))
        .when((c("channels") != len(fv.RADAR_CHANNELS)) | (c("bands") != len(fv.PACKED_BANDS)), F.lit("mismatched"))
        .when(c("s1_side") != c("s2_side"), F.lit("bad_dimensions"))
        .otherwise(F.lit("valid"))
    )
    return joined.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n_pairs"))


def tile_groups(patches: DataFrame) -> DataFrame:
    key = text.tile_date_key(F.col("patch_id")).alias("tile_date")
    return patches.groupBy(key).agg(F.count(F.lit(1)).alias("n_patches"))


def triplet_counts(listing: DataFrame) -> DataFrame:
    """Files per split in the folders A, B and label over ``<split>/<folder>/<file>`` paths, and whole triplets."""
    parts = F.split("path", "/")
    split, folder, stem = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    rows = listing.select(split.alias("split"), folder.alias("folder"), stem.alias("file"))
    per_file = rows.groupBy("split", "file").agg(
        *[F.count_if(F.col("folder") == d).alias(n) for d, n in (("A", "n_a"), ("B", "n_b"), ("label", "n_label"))]
    )
    whole = (F.col("n_a") > 0) & (F.col("n_b") > 0) & (F.col("n_label") > 0)
    return per_file.groupBy("split").agg(
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.sum("n_label").alias("n_label"),
        F.count_if(whole).alias("n_triplets"),
    )


def upsert_patch_bands(store: DataFrame, new: DataFrame) -> DataFrame:
    """Add radar to stored optical patches and the other way round: the new side wins where it has a value.
    Write the result to a new path and swap; the old store stays readable meanwhile."""
    s, n = store.alias("s"), new.alias("n")
    return s.join(n, F.col("s.patch_id") == F.col("n.patch_id"), "full").select(
        F.coalesce("n.patch_id", "s.patch_id").alias("patch_id"),
        F.coalesce("n.s2", "s.s2").alias("s2"),
        F.coalesce("n.s1", "s.s1").alias("s1"),
    )


def imagery_stats(entries: DataFrame, index: DataFrame) -> DataFrame:
    """How many training entries have real imagery. The index is one row per patch, so a frequent patch costs nothing
    extra once entries are counted per patch first."""
    per_patch = entries.groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    have = index.select(F.col("patch_id").alias("image")).distinct().withColumn("real", F.lit(True))
    counts = per_patch.join(have, "image", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("real"), F.col("n"))), F.lit(0)).alias("real_imagery"),
    )
    return counts.withColumns(
        {
            "synthetic_imagery": F.col("total") - F.col("real_imagery"),
            "real_pct": F.coalesce(F.try_divide(F.col("real_imagery") * 100.0, F.col("total")), F.lit(0.0)),
        }
    )
