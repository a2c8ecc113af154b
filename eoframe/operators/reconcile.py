"""Disagreement between model outputs and the confidence that results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eoframe.config import ConfidenceConfig
from eoframe.functions import geometry, text

PAIR_FIELDS = ["model_name", "prediction", "confidence", "norm", "boxes"]


def _words(p: Column) -> Column:
    return text.words_of(F.translate(p, ",;", "  "))


def detect_disagreement(outputs: DataFrame, iou: float = 0.5) -> DataFrame:
    """Agreement status per request over (request_id, position, model_name, prediction, pred_kind, confidence, boxes).

    Counts and equality come from min/max aggregates; only the first two outputs of a request are kept as rows (the
    window group limit drops the others map-side), so a request with very many outputs is never collected. Boxes that
    do not touch at all (DISJOINT) do not lower an agreement, and three or more outputs are never partially alike.
    """
    rows = outputs.withColumn("norm", text.normalize_prediction(F.col("prediction"), F.col("pred_kind")))
    facts = rows.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_outputs"), F.min("norm").alias("__lo"), F.max("norm").alias("__hi"),
        F.bool_and(F.col("boxes").isNotNull()).alias("__all_boxes"),
    )
    w = W.partitionBy("request_id").orderBy("position")
    top = rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= 2)
    firsts = top.groupBy("request_id").agg(
        *[F.max(F.when(F.col("__rn") == i, F.struct(*PAIR_FIELDS))).alias(f"m{i}") for i in (1, 2)]
    )
    joined = facts.join(firsts, "request_id")
    two = F.col("n_outputs") == 2
    spatial = F.when(
        two & F.col("__all_boxes"), geometry.match_boxes(F.col("m1.boxes"), F.col("m2.boxes"), iou)
    )
    same = F.col("__lo") == F.col("__hi")
    shared = two & F.arrays_overlap(_words(F.col("m1.norm")), _words(F.col("m2.norm")))
    single = F.col("n_outputs") == 1
    misplaced = F.coalesce(F.col("spatial")["status"] == "DISAGREEMENT", F.lit(False))
    status = (
        F.when(single, F.lit("AGREEMENT"))
        .when(same & misplaced, F.lit("PARTIAL_AGREEMENT"))
        .when(same, F.lit("AGREEMENT"))
        .when(shared, F.lit("PARTIAL_AGREEMENT"))
        .otherwise(F.lit("DISAGREEMENT"))
    )
    reason = (
        F.when(single, F.lit("single output"))
        .when(same & misplaced, F.lit("same prediction, misaligned boxes"))
        .when(same, F.lit("same prediction"))
        .when(shared, F.lit("overlapping predictions"))
        .otherwise(F.lit("contradictory predictions"))
    )

    def said(m: str) -> Column:
        conf = F.coalesce(
            F.concat(F.lit(" (confidence: "), F.format_string("%.2f", F.col(f"{m}.confidence")), F.lit(")")), F.lit("")
        )
        return F.concat(F.col(f"{m}.model_name"), F.lit(": '"), F.coalesce(f"{m}.prediction", F.lit("None")), F.lit("'"), conf)

    return (
        joined.withColumn("spatial", spatial)
        .withColumns({"status": status, "reason": reason})
        .withColumn(
            "impact",
            F.when(F.col("status") == "AGREEMENT", F.lit("NO_IMPACT"))
            .when(F.col("status") == "PARTIAL_AGREEMENT", F.lit("MINOR_PENALTY"))
            .otherwise(F.lit("MAJOR_PENALTY")),
        )
        .withColumn("explanation", F.when(single, said("m1")).otherwise(F.concat_ws("; ", said("m1"), said("m2"))))
        .select("request_id", "n_outputs", "status", "reason", "impact", "explanation", "spatial")
    )


def full_reports(requests: DataFrame, outputs: DataFrame, iou: float = 0.5) -> DataFrame:
    """Reports with all their fields for every request, those without any output included.

    To the fields of ``detect_disagreement`` come participating_models (in order of position), individual_predictions and
    individual_confidences (by model; a model named twice keeps its last output), provenance_refs (of outputs that have a
    provenance_id) and comparison_summary. The outputs of a request are the report, so they meet in one row.
    """
    if "provenance_id" not in outputs.columns:
        outputs = outputs.withColumn("provenance_id", F.lit(None).cast("string"))
    said = F.array_sort(F.collect_list(F.struct("position", "model_name", "prediction", "confidence", "provenance_id")))
    listed = outputs.groupBy("request_id").agg(said.alias("said"))

    def by_model(field: str) -> Column:
        last = F.filter("said", lambda x, i: ~F.exists(F.slice("said", i + 2, F.size("said")), lambda y: y["model_name"] == x["model_name"]))
        return F.map_from_entries(F.transform(last, lambda x: F.struct(x["model_name"], x[field])))

    refs = F.transform(F.filter("said", lambda x: F.coalesce(x["provenance_id"], F.lit("")) != ""), lambda x: x["provenance_id"])
    members = listed.select(
        "request_id", F.transform("said", lambda x: x["model_name"]).alias("participating_models"),
        by_model("prediction").alias("individual_predictions"), by_model("confidence").alias("individual_confidences"),
        refs.alias("provenance_refs"),
    )
    reports = with_silent_requests(requests, detect_disagreement(outputs, iou)).join(members, "request_id", "left")
    texts, names = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    summary = (
        F.when(F.col("n_outputs") == 0, F.lit("no outputs"))
        .when(F.col("n_outputs") == 1, F.concat(F.lit("single output of "), F.get("participating_models", F.lit(0))))
        .otherwise(F.concat(F.col("n_outputs").cast("string"), F.lit(" outputs: "), F.col("status")))
    )
    return reports.withColumns({
        "participating_models": F.coalesce("participating_models", texts), "provenance_refs": F.coalesce("provenance_refs", texts),
        "individual_predictions": F.coalesce("individual_predictions", names),
        "individual_confidences": F.coalesce("individual_confidences", F.create_map().cast("map<string,double>")),
        "comparison_summary": summary,
    })


def with_silent_requests(requests: DataFrame, reports: DataFrame) -> DataFrame:
    """Requests without any output get the status that says so."""
    return requests.select("request_id").join(reports, "request_id", "left").withColumns(
        {
            "status": F.coalesce("status", F.lit("INSUFFICIENT_INFORMATION")),
            "impact": F.coalesce("impact", F.lit("NO_IMPACT")),
            "n_outputs": F.coalesce("n_outputs", F.lit(0)),
        }
    )


def individual_predictions(outputs: DataFrame) -> DataFrame:
    """One row per request and model; a model named twice keeps its last output."""
    return outputs.groupBy("request_id", "model_name").agg(
        F.max_by("prediction", "position").alias("prediction"), F.max_by("confidence", "position").alias("confidence")
    )


def clamp01(v: Column) -> Column:
    """[0, 1] clamp that maps NaN to 0 (a plain greatest/least would map it to 1)."""
    return F.nanvl(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(v), F.lit(0.0)).otherwise(v))), F.lit(0.0))


def _quality(cfg: ConfidenceConfig, optical: Column) -> tuple[Column, Column, Column, Column]:
    c = F.col
    cloud = F.when(
        optical & c("cloud_cover_percentage").isNotNull(), 1.0 - clamp01(c("cloud_cover_percentage") / 100.0)
    ).otherwise(F.lit(1.0))
    base = F.when(c("is_complete") == F.lit(False), F.lit(0.70)).otherwise(F.lit(1.0))
    meta = F.when(c("has_georeference") == F.lit(False), F.least(base, F.lit(0.50))).otherwise(base)
    align = F.coalesce(clamp01(c("alignment_iou")), F.lit(1.0))
    score = clamp01(cloud * cfg.cloud_weight + meta * cfg.metadata_weight + align * cfg.alignment_weight)
    return cloud, meta, align, score


def input_quality(df: DataFrame, cfg: ConfidenceConfig | None = None) -> DataFrame:
    """Quality from (is_optical, cloud_cover_percentage, is_complete, has_georeference, alignment_iou); radar ignores
    clouds, missing facts count as good."""
    cloud, meta, align, score = _quality(cfg or ConfidenceConfig(), F.col("is_optical"))
    return df.withColumns(
        {"cloud_factor": cloud, "metadata_factor": meta, "alignment_factor": align, "input_quality": score}
    )


def aggregate_confidence(df: DataFrame, cfg: ConfidenceConfig | None = None) -> DataFrame:
    """Final confidence from model, agreement and input quality, less the disagreement penalty.

    The paired weights apply only when an agreement score is present; any severity but PARTIAL, NONE included, takes
    the full penalty once a disagreement was detected.
    """
    cfg = cfg or ConfidenceConfig()
    c = F.col
    opt, sar, raw, agree = (c(n) for n in ("optical_confidence", "sar_confidence", "model_confidence", "agreement_score"))
    both = opt.isNotNull() & sar.isNotNull()
    model = (
        F.when(both, (clamp01(opt) + clamp01(sar)) / 2.0)
        .when(opt.isNotNull(), clamp01(opt))
        .when(sar.isNotNull(), clamp01(sar))
        .when(raw.isNotNull(), clamp01(raw))
        .otherwise(F.lit(cfg.default_model_confidence))
    )
    only_raw = opt.isNull() & sar.isNull() & raw.isNotNull()
    paired = (both | only_raw) & agree.isNotNull()
    *_, quality = _quality(cfg, opt.isNotNull() | sar.isNull())
    penalty = F.when(
        c("disagreement_detected"),
        F.when(F.upper("severity") == "PARTIAL", F.lit(cfg.partial_penalty)).otherwise(F.lit(cfg.disagreement_penalty)),
    ).otherwise(F.lit(0.0))
    staged = df.withColumns(
        {
            "model_term": model, "agreement_term": F.when(paired, clamp01(agree)), "quality_term": quality,
            "penalty": penalty,
        }
    )
    final = F.when(
        c("agreement_term").isNotNull(),
        cfg.paired_model * c("model_term") + cfg.paired_agreement * c("agreement_term")
        + cfg.paired_quality * c("quality_term") - c("penalty"),
    ).otherwise(cfg.single_model * c("model_term") + cfg.single_quality * c("quality_term") - c("penalty"))
    return staged.withColumn("final_confidence", clamp01(final))


def confidence_report(df: DataFrame, cfg: ConfidenceConfig | None = None) -> DataFrame:
    """``aggregate_confidence`` as an auditable record: numbers to 4 digits, the components that went in, and the method's version.

    A component that played no part is null in ``confidence_components``.
    """
    cfg = cfg or ConfidenceConfig()
    c, out = F.col, aggregate_confidence(df, cfg)
    opt, sar = c("optical_confidence"), c("sar_confidence")
    cloud, meta, align, quality = _quality(cfg, opt.isNotNull() | sar.isNull())
    alone = opt.isNull() & sar.isNull()

    def digits(x: Column) -> Column:
        return F.round(x, 4)

    components = F.struct(
        F.when(opt.isNotNull(), clamp01(opt)).alias("optical_model_confidence"),
        F.when(sar.isNotNull(), clamp01(sar)).alias("sar_model_confidence"),
        F.when(alone & c("model_confidence").isNotNull(), clamp01(c("model_confidence"))).alias("raw_model_confidence"),
        F.when(alone & c("model_confidence").isNull(), F.lit(True)).alias("model_confidence_assumed_default"),
        digits(cloud).alias("cloud_quality_factor"), digits(meta).alias("metadata_quality_factor"),
        digits(align).alias("spatial_alignment_factor"), c("penalty").alias("disagreement_penalty"),
    )
    keep = [n for n in df.columns if n not in ("model_confidence", "agreement_score", "final_confidence")]
    return out.select(
        *keep, digits(c("model_term")).alias("model_confidence"), digits(c("agreement_term")).alias("agreement_score"),
        digits(quality).alias("input_quality_score"), digits(c("final_confidence")).alias("final_confidence"),
        components.alias("confidence_components"), digits(c("penalty")).alias("disagreement_penalty_applied"),
        F.lit(cfg.version).alias("confidence_method_version"),
    )


def light_confidence(df: DataFrame) -> DataFrame:
    """The lightweight service score with its defaults; agreement below 0.60 flags a disagreement."""
    m, a, q = (
        F.coalesce(F.col(n), F.lit(d))
        for n, d in (("model_confidence", 0.75), ("cross_modal_agreement", 1.0), ("input_quality", 0.9))
    )
    return df.withColumns(
        {"score": F.round(0.55 * m + 0.25 * a + 0.20 * q, 4), "disagreement": a < 0.60}
    )


def normalize_attribution(df: DataFrame) -> DataFrame:
    """Optical and radar shares that sum to 1; two zeros are split evenly (our reading, only the sum is pinned)."""
    o, s = F.col("optical"), F.col("sar")
    total = F.nullif(o + s, F.lit(0.0))
    return df.withColumns(
        {"optical_share": F.coalesce(o / total, F.lit(0.5)), "sar_share": F.coalesce(s / total, F.lit(0.5))}
    )
