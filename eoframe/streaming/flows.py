"""Stateless streams and the reconciliation stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe.config import ConfidenceConfig, ValidationConfig
from eoframe.operators import query_log as ql
from eoframe.operators import reconcile as rc
from eoframe.operators import validation as va
from eoframe.streaming.gather import SetRule, gather
from eoframe.streaming.runtime import run_batches


def classify_stream(stream: DataFrame, registry: DataFrame) -> DataFrame:
    """Intent and scope check of arriving queries; the registry is a small static side."""
    return ql.check_scope(ql.classify_queries(stream), registry)


def validate_stream(stream: DataFrame, cfg: ValidationConfig | None = None) -> dict[str, DataFrame]:
    """Metadata gate with two sinks, valid and rejected."""
    def sinks(batch: DataFrame) -> dict[str, DataFrame]:
        checked = va.validate_images(batch, cfg)
        return {"valid": checked.filter("is_valid"), "rejected": checked.filter(~F.col("is_valid"))}

    return run_batches(stream, "validation", sinks)


#: A request that some model never answers is given up after a day.
PATIENCE_MS = 86_400_000


def reconcile_stream(
    outputs: DataFrame, expected: DataFrame, cfg: ConfidenceConfig | None = None, folder: str | None = None,
    ttl_ms: int | None = PATIENCE_MS,
) -> DataFrame:
    """Reports and confidence of requests once every model has answered; ``expected`` (request_id, n_models) says how many.

    Completed requests go through the same operators as the batch job. A request that stays incomplete for ``ttl_ms`` gets none;
    answers that come later than that after its report would begin it anew.
    """
    answers = outputs.join(expected.select("request_id", "n_models"), "request_id").withColumn(
        "answer", F.struct("model_name", "prediction", "pred_kind", "confidence", "position")
    )
    rule = SetRule("request_id", "model_name", "answer", "position", "n_models", ttl_ms=ttl_ms)

    def sinks(sets: DataFrame) -> dict[str, DataFrame]:
        whole = sets.where("status = 'complete'").select(F.col("key").alias("request_id"), F.explode("items").alias("model", "o"))
        rows = whole.select("request_id", "o.*").withColumn(
            "boxes",
            F.lit(None).cast("array<struct<min_x:double,min_y:double,max_x:double,max_y:double,label:string,confidence:double>>"),
        )
        reports = rc.detect_disagreement(rows)
        means = rows.groupBy("request_id").agg(F.avg("confidence").alias("model_confidence"))
        numbers = ("optical_confidence", "sar_confidence", "agreement_score", "cloud_cover_percentage", "alignment_iou")
        absent = {n: F.lit(None).cast("double") for n in numbers}
        flags = {n: F.lit(None).cast("boolean") for n in ("is_complete", "has_georeference")}
        scored = rc.aggregate_confidence(
            reports.join(means, "request_id").withColumns({
                **absent, **flags, "disagreement_detected": F.col("status") != "AGREEMENT",
                "severity": F.when(F.col("status") == "PARTIAL_AGREEMENT", F.lit("PARTIAL")).otherwise(F.lit("MATERIAL")),
            }),
            cfg,
        )
        return {"reports": scored.select("request_id", "n_outputs", "status", "impact", "final_confidence")}

    return gather(answers, rule, sinks, "reconcile", folder)["reports"]
