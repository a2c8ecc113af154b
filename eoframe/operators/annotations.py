"""Annotation table: profiling, filters, label sets, instruction formatting and mixtures.

Annotation columns: ann_id, patch_id, s1_name, input, output, type, category, split, country, season, climate_zone,
latitude, longitude.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv
from eoframe.functions import text
from eoframe.session import materialize

ENTRY_TYPE = "array<struct<from:string,value:string>>"


# --- filters ----------------------------------------------------------------------------------------------------------

def filter_split(df: DataFrame, split: str) -> DataFrame:
    return df.filter(F.col("split") == split)


def positive_labels(ann: DataFrame) -> DataFrame:
    """Yes/no rows answered yes, whatever the padding and case."""
    return ann.filter((F.col("type") == "binary") & (text.norm(F.col("output")) == "yes"))


def template_table(df: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    rows = list((templates or fv.PROMPT_TEMPLATES).items())
    return df.sparkSession.createDataFrame(rows, "type string, template string")


def known_types(df: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Rows whose type has a template; the template table is one row per template."""
    return df.join(F.broadcast(template_table(df, templates).select("type")), "type", "left_semi")


def keep_patches(ann: DataFrame, ids: DataFrame) -> DataFrame:
    return ann.join(ids.select("patch_id"), "patch_id", "left_semi")


def unseen_patches(cached: DataFrame, *used: DataFrame) -> DataFrame:
    """Cached patches that none of the used sets contains: one anti join against their union."""
    seen = reduce(lambda a, b: a.union(b), [u.select("patch_id") for u in used])
    return cached.select("patch_id").distinct().join(seen, "patch_id", "left_anti")


def attach_patch_attrs(df: DataFrame, attrs: DataFrame) -> DataFrame:
    return df.join(attrs, "patch_id", "left")


# --- per-patch aggregates ---------------------------------------------------------------------------------------------

def first_per_patch(ann: DataFrame, cols: list[str], order: str = "ann_id", skip_nulls: bool = True) -> DataFrame:
    """First attribute per patch in row order. ``skip_nulls`` picks the first known value per column; without it the
    first row decides, nulls included."""
    if skip_nulls:
        aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols]
        return ann.groupBy("patch_id").agg(*aggs)
    first = ann.groupBy("patch_id").agg(F.min_by(F.struct(*cols), order).alias("__first"))
    return first.select("patch_id", *[F.col(f"__first.{c}").alias(c) for c in cols])


def label_sets(ann: DataFrame) -> DataFrame:
    """Sorted distinct positive labels per patch (trimmed, case kept, every split). Patches without one are absent.

    Labels come from a closed vocabulary and are made distinct map-side, so the array does not grow with the rows.
    """
    return (
        positive_labels(ann)
        .select("patch_id", text.strip(F.col("input")).alias("label"))
        .groupBy("patch_id")
        .agg(F.sort_array(F.collect_set("label")).alias("labels"))
    )


def types_per_patch(ann: DataFrame) -> DataFrame:
    return ann.groupBy("patch_id").agg(
        F.sort_array(F.collect_set("type")).alias("types"),
        F.sort_array(F.collect_set("category")).alias("categories"),
    )


def class_statistics(labels: DataFrame) -> DataFrame:
    """Patches per class over (patch_id, labels)."""
    return labels.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n_patches"))


def profile_annotations(ann: DataFrame) -> DataFrame:
    """metric, key, value: totals, distinct training patches, rows by type and by category (nulls not counted).

    The annotations are read twice: once counted by (split, type, category), from which all counts are taken, and once for the
    distinct patches.
    """
    counted = ann.groupBy("split", "type", "category").agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "profile")
    train = F.col("split") == "train"
    patches = filter_split(ann, "train").agg(F.countDistinct("patch_id").alias("value"))

    def row(df: DataFrame, metric: str, key: Column) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), key.alias("key"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    def by(col: str) -> DataFrame:
        rows = counted.filter(train & F.col(col).isNotNull()).groupBy(F.col(col).alias("key"))
        return row(rows.agg(F.sum("n").alias("value")), f"rows_by_{col}", F.col("key"))

    every = F.lit("all")
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            row(counted.agg(F.sum("n").alias("value")), "total_annotations", every),
            row(counted.filter(train).agg(F.sum("n").alias("value")), "train_annotations", every),
            row(patches, "unique_patches", every), by("type"), by("category"),
        ],
    )


# --- instruction entries ----------------------------------------------------------------------------------------------

def _turns(human: Column, gpt: Column) -> Column:
    def turn(role: str, value: Column) -> Column:
        return F.struct(F.lit(role).alias("from"), value.alias("value"))

    return F.array(turn("human", human), turn("gpt", gpt)).cast(ENTRY_TYPE)


def format_instructions(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Instruction entries from annotations; the captioning prompt ignores the input and unknown types are dropped.
    A missing text is printed as ``None``, which is what the reference writes. ``keep`` columns come along."""
    prompt = F.replace(F.col("template"), F.lit("{input}"), F.coalesce(F.col("input"), F.lit("None")))
    joined = df.join(F.broadcast(template_table(df)), "type")
    return joined.select(
        F.concat_ws("_", "type", "patch_id", F.col("ann_id").cast("string")).alias("id"),
        F.col("patch_id").alias("image"),
        "s1_name",
        _turns(prompt, F.coalesce(F.col("output").cast("string"), F.lit("None"))).alias("conversations"),
        F.col("type").alias("task_type"),
        *keep,
    )


def to_conversations(df: DataFrame) -> DataFrame:
    """One shape for rows with ready conversations and rows with question/answer columns."""
    built = _turns(
        F.concat(F.lit("<image>\n"), F.coalesce("input", F.lit(""))), F.coalesce("output", F.lit(""))
    )
    ready = F.col("conversations").isNotNull()
    return df.select(
        F.when(ready, F.col("image")).otherwise(F.coalesce("image", F.lit(""))).alias("image"),
        F.coalesce("conversations", built).alias("conversations"),
        F.when(ready, F.col("category")).otherwise(F.coalesce("category", F.lit("unknown"))).alias("category"),
    )


def render_chat(entries: DataFrame) -> DataFrame:
    """Chat-template text; entries that do not have exactly two turns get a reject reason instead."""
    human, gpt = F.get("conversations", F.lit(0))["value"], F.get("conversations", F.lit(1))["value"]
    prompted = F.when(human.contains("<image>"), human).otherwise(F.concat(F.lit("<image>\n"), human))
    two = F.size("conversations") == 2
    rendered = F.concat(
        F.lit("<|im_start|>user\n"), prompted, F.lit("<|im_end|>\n<|im_start|>assistant\n"), gpt, F.lit("<|im_end|>\n")
    )
    return entries.withColumns(
        {
            "chat": F.when(two, rendered),
            "reject_reason": F.when(
                ~two, F.concat(F.lit("expected 2 turns, got "), F.size("conversations").cast("string"))
            ),
        }
    )


def last_turn(role: str, conversations: str = "conversations") -> Column:
    turns = F.filter(F.col(conversations), lambda t: t["from"] == role)
    return F.coalesce(F.try_element_at(turns, F.lit(-1))["value"], F.lit(""))


def build_manifest(entries: DataFrame, order: str) -> DataFrame:
    """One row per patch; the last entry decides the radar name."""
    return entries.groupBy(F.col("image").alias("patch_id")).agg(
        F.max_by(F.coalesce("s1_name", F.lit("")), order).alias("s1_name")
    )


def required_patches(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("image").alias("patch_id")).distinct()


# --- mixtures ---------------------------------------------------------------------------------------------------------

def mix(frames: dict[str, DataFrame]) -> DataFrame:
    """Bag union with the category overridden by the part's name."""
    parts = [f.withColumn("category", F.lit(name)) for name, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def oversample(df: DataFrame, k: int) -> DataFrame:
    """Every row k times, exactly; ``copy`` tells the copies apart."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(k))))


def mixture_report(df: DataFrame) -> DataFrame:
    """Rows and share by category. Shares are only reported; no target is enforced."""
    counts = df.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("share_pct", F.col("n_rows") * 100.0 / total)
