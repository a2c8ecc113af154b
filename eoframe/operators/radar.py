"""Radar and fusion question sets derived from land-cover labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv
from eoframe.functions import text
from eoframe.functions.ranking import hash_index

CATEGORIES = list(fv.RADAR_PROPERTIES)


def classify_sar(labels: Column) -> Column:
    """Radar categories of a label array: substring hits over the joined lower-case labels, list order kept, or
    ``unknown``. "sea" matches "season": substring tests are the rule."""
    joined = F.lower(F.array_join(labels, " "))
    return _or_unknown([text.contains_any(joined, fv.RADAR_PROPERTIES[c]["keywords"]) for c in CATEGORIES])


def _or_unknown(hits: list[Column]) -> Column:
    found = F.array_compact(F.array(*[F.when(h, F.lit(c)) for c, h in zip(CATEGORIES, hits)]))
    return F.when(F.size(found) == 0, F.array(F.lit("unknown"))).otherwise(found)


def patch_categories(ann: DataFrame, cached: DataFrame) -> DataFrame:
    """(patch_id, categories) of cached patches with yes/no training rows; patches without a yes are ``unknown``.

    One boolean per category is aggregated instead of collecting label texts, so a patch with very many rows is reduced
    map-side. A keyword cannot start in one question and end in the next because questions end in punctuation.
    """
    binary = ann.filter((F.col("split") == "train") & (F.col("type") == "binary"))
    binary = binary.join(cached.select("patch_id"), "patch_id", "left_semi")
    yes, words = text.norm(F.col("output")) == "yes", F.lower("input")
    flags = [
        F.bool_or(yes & text.contains_any(words, fv.RADAR_PROPERTIES[c]["keywords"])).alias(f"has_{c}")
        for c in CATEGORIES
    ]
    flagged = binary.groupBy("patch_id").agg(*flags)
    return flagged.select("patch_id", _or_unknown([F.col(f"has_{c}") for c in CATEGORIES]).alias("categories"))


def category_counts(categories: DataFrame) -> DataFrame:
    """Patches per radar category; a patch counts once in each of its categories."""
    exploded = categories.select("patch_id", F.explode(F.array_distinct("categories")).alias("category"))
    return exploded.groupBy("category").agg(F.count(F.lit(1)).alias("n_patches"))


def _property_table(df: DataFrame) -> DataFrame:
    rows = [
        (c, p["backscatter"], p["mechanism"], p["texture"], p["moisture"]) for c, p in fv.RADAR_PROPERTIES.items()
    ]
    return df.sparkSession.createDataFrame(
        rows, "cat string, backscatter string, mechanism string, texture string, moisture string"
    )


def generate_sar_qa(categories: DataFrame, seed: int) -> DataFrame:
    """Six question rows per known category; the negative one borrows the mechanism of a hash-chosen other category."""
    props = _property_table(categories)
    exploded = categories.select(F.col("patch_id").alias("image"), F.explode("categories").alias("cat"))
    others = F.array_except(F.array(*[F.lit(c) for c in CATEGORIES]), F.array("cat"))
    picked = exploded.filter(F.col("cat") != "unknown").withColumn(
        "negative", F.get(others, hash_index(seed, len(CATEGORIES) - 1, F.concat_ws("|", "image", "cat")))
    )
    wrong = props.select(F.col("cat").alias("negative"), F.col("mechanism").alias("negative_mechanism"))
    rich = picked.join(F.broadcast(props), "cat").join(F.broadcast(wrong), "negative")

    def fill(template: str) -> Column:
        out = F.lit(template)
        for name in ("backscatter", "negative_mechanism", "mechanism", "texture", "moisture", "cat"):
            if "{" + name + "}" in template:
                out = F.replace(out, F.lit("{" + name + "}"), F.col(name))
        return out

    rows = F.array(
        *[
            F.struct(F.lit(i).alias("n"), fill(q).alias("input"), fill(a).alias("output"), F.lit(kind).alias("type"),
                     fill(category).alias("category"))
            for i, (q, a, kind, category) in enumerate(fv.RADAR_QA_TEMPLATES)
        ]
    )
    return rich.select("image", "cat", F.explode(rows).alias("r")).select(
        "image", F.concat_ws("|", "image", "cat", F.col("r.n").cast("string")).alias("qa_key"),
        "r.input", "r.output", "r.type", "r.category",
    )


def landcover_class(categories: Column) -> Column:
    """One land cover per patch. The reference's classifier is not published; ours is the first radar category, with
    crop reported as agricultural."""
    first = F.get(categories, F.lit(0))
    return F.when(first == "crop", F.lit("agricultural")).otherwise(first)


def generate_fusion_qa(patches: DataFrame, seed: int) -> DataFrame:
    """One hash-chosen template of each family per patch, plus the row tied to its land cover, over
    (patch_id, landcover)."""
    families = []
    for family, templates in fv.FUSION_TEMPLATES.items():
        options = F.array(*[F.struct(F.lit(q).alias("input"), F.lit(a).alias("output")) for q, a in templates])
        pick = F.get(options, hash_index(seed, len(templates), F.concat_ws("|", "patch_id", F.lit(family))))
        families.append(
            F.struct(pick["input"].alias("input"), pick["output"].alias("output"),
                     F.lit(f"fusion_{family}").alias("category"))
        )
    special = [
        F.when(
            F.col("landcover") == cover,
            F.struct(F.lit(q).alias("input"), F.lit(a).alias("output"), F.lit(f"fusion_{cover}").alias("category")),
        )
        for cover, (q, a) in fv.LANDCOVER_FUSION_TEMPLATES.items()
    ]
    rows = F.array_compact(F.array(*families, F.coalesce(*special)))
    return patches.select(F.col("patch_id").alias("image"), "landcover", F.explode(rows).alias("r")).select(
        "image", "landcover", F.concat_ws("|", "image", "r.category").alias("qa_key"), "r.input", "r.output",
        F.lit("descriptive").alias("type"), "r.category",
    )
