"""A request from its query to its trace: intent, dispatch, the tool's answer, confidence, provenance and events in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe.operators import query_log as ql
from eoframe.operators import reconcile as rc

CONTROLLER = "request-controller"


def run_requests(requests: DataFrame, registry: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests (request_id, query, input_scope, task_hint, image_ids) with task, status, error, score and disagreement.

    ``answers`` holds what the tools gave (request_id, ml_status, ml_error, model_version, model_confidence, cross_modal_agreement,
    input_quality, ml_disagreement); of several answers to one request the one with the greatest hash counts. A request is
    ``rejected`` by the classifier or for its input, ``failed`` without a fitting tool or by the tool, and else ``success``; only
    then it has a score. A dispatched request without an answer has status ``running``.
    """
    sent = ql.dispatch(ql.classify_queries(requests), registry)
    whole = F.struct(*[c for c in answers.columns if c != "request_id"])
    one = answers.groupBy("request_id").agg(F.max_by(whole, F.xxhash64(whole)).alias("a")).select("request_id", "a.*")
    joined = sent.join(one, "request_id", "left")
    scored = rc.light_confidence(joined)
    answered = (F.col("status") == "dispatched") & F.col("ml_status").isNotNull()
    good = answered & (F.col("ml_status") == "success")
    final = (
        F.when(F.col("status") != "dispatched", F.col("status")).when(good, F.lit("success")).when(answered, F.lit("failed"))
        .otherwise(F.lit("running"))
    )
    return scored.withColumns({
        "score": F.when(good, F.col("score")),
        "disagreement": F.when(good, F.col("disagreement") | F.coalesce("ml_disagreement", F.lit(False))),
        "error": F.when(answered & ~good, F.coalesce("ml_error", F.lit("tool failed"))).otherwise(F.col("error")),
        "final_status": final,
    })


def request_records(runs: DataFrame, timestamp: str) -> DataFrame:
    """One provenance record per successful request; ``timestamp`` is given, so a rerun yields the same."""
    good = runs.where("final_status = 'success'")
    return good.select(
        F.lit(CONTROLLER).alias("controller"), "request_id", "task", F.col("task").alias("block"), "endpoint", "model_version",
        F.col("image_ids").alias("input_image_ids"), "input_scope", F.lit(timestamp).alias("timestamp"),
    )


def request_traces(runs: DataFrame) -> DataFrame:
    """Traces of all requests that are not running."""
    return ql.assemble_traces(ql.lifecycle_events(runs.where("final_status <> 'running'")))
