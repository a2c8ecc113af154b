"""The training mixture as one build: general entries, radar questions twice, fusion questions on balanced land cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe.operators import annotations as an
from eoframe.operators import radar
from eoframe.operators import sampling as sm
from eoframe.session import materialize

COLUMNS = ["id", "image", "input", "output", "category", "split", "copy"]


def build_mixture(
    general: DataFrame, categories: DataFrame, seed: int, radar_copies: int = 2, fusion_target: int = 800, per_patch: int = 5
) -> DataFrame:
    """One row per training or validation entry: id, image, input, output, category, split, copy.

    ``general``: entries with id, image, input, output and split (train or val). ``categories``: radar categories by patch_id.
    Radar questions are split 80/20 by row, and their training rows come ``radar_copies`` times. Fusion questions are made for
    patches of the general training set, equally many of each land cover (``fusion_target`` // classes // ``per_patch``), and
    split 85/15 by row with at least 20 for validation. The category tells the part; ``copy`` is 1 but for repeated rows.
    """
    questions = radar.generate_sar_qa(categories, seed).withColumn("id", F.col("qa_key"))
    questions = materialize(questions.select("id", "image", "input", "output"), "radar-questions")
    split = sm.split_rows(questions, seed, "id", [("train", 0.8)], "val")
    sar = an.oversample(split.where("split = 'train'"), radar_copies).unionByName(
        split.where("split = 'val'").withColumn("copy", F.lit(1))
    )
    trained = general.where("split = 'train'").select(F.col("image").alias("patch_id")).distinct()
    covers = categories.select("patch_id", radar.landcover_class(F.col("categories")).alias("landcover"))
    covers = materialize(covers.join(trained, "patch_id", "left_semi"), "land-covers")
    chosen = sm.sample_by_class(covers, "landcover", fusion_target, per_patch, seed, "patch_id")
    fused = radar.generate_fusion_qa(chosen.select("patch_id", "landcover"), seed)
    fused = materialize(fused.select(F.col("qa_key").alias("id"), "image", "input", "output"), "fusion-questions")
    fused = sm.split_rows(fused, seed, "id", [("val", 0.15)], "train", floor=20)
    one = F.lit(1).alias("copy")
    return an.mix({
        "general": general.select("id", "image", "input", "output", "split", one), "sar": sar,
        "fusion": fused.withColumn("copy", F.lit(1)),
    }).select(*COLUMNS)
