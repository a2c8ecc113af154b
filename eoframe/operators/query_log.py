"""Query requests: intent, admission, dispatch and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv
from eoframe.functions import text


def classify_queries(df: DataFrame) -> DataFrame:
    """Adds task and reject_reason over (query, input_scope, task_hint)."""
    staged = text.intent_facts(df, F.col("query"), F.col("input_scope"))
    task, reason = text.intent_verdict(F.col("input_scope"), F.col("task_hint"))
    return staged.withColumn("__v", F.struct(task.alias("task"), reason.alias("reason"))).select(
        *[c for c in df.columns if c not in ("task", "reject_reason")],
        F.col("__v.task").alias("task"), F.col("__v.reason").alias("reject_reason"),
    )


def classify_queries_regex(df: DataFrame) -> DataFrame:
    """Word-bounded client rules over (query, file_names, n_files, selected_task)."""
    return df.withColumn(
        "task",
        text.classify_intent_client(
            F.col("query"), F.col("file_names"), F.col("n_files"), F.coalesce("selected_task", F.lit(""))
        ),
    )


def check_requests(df: DataFrame) -> DataFrame:
    """Query of 1 to 2000 characters and one or two image ids, none blank."""
    n, ids = F.length(F.coalesce("query", F.lit(""))), F.col("image_ids")
    reasons = F.array_compact(
        F.array(
            F.when(n < 1, F.lit("query is empty")),
            F.when(n > 2000, F.lit("query is too long")),
            F.when(F.size(ids) < 1, F.lit("no image id")),
            F.when(F.size(ids) > 2, F.lit("too many image ids")),
            F.when(F.exists(ids, lambda i: text.strip(i) == ""), F.lit("blank image id")),
        )
    )
    return df.withColumn("request_reasons", reasons).withColumn("request_ok", F.size("request_reasons") == 0)


def registry_table(df: DataFrame) -> DataFrame:
    """The tool registry as a table; new tools are new rows."""
    return df.sparkSession.createDataFrame(
        [(t, e, s, d, True) for t, e, s, d in fv.TOOL_REGISTRY],
        "task string, endpoint string, required_scope string, description string, enabled boolean",
    )


def check_scope(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Task/scope compatibility with reasons. A task without a registry row has no scope requirement."""
    need = registry.select("task", F.col("required_scope").alias("__need"))
    joined = df.join(need, "task", "left")
    reasons = F.array_compact(
        F.array(
            F.when(
                F.col("__need") != F.col("input_scope"),
                F.concat(F.col("task"), F.lit(" requires "), F.col("__need"), F.lit(" input scope")),
            ),
            F.when(F.size("image_ids") > 2, F.lit("maximum of two images is supported")),
        )
    )
    return joined.withColumn("scope_reasons", reasons).withColumn("scope_ok", F.size("scope_reasons") == 0).drop("__need")


def dispatch(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """Tool and final status of classified queries. A classifier refusal or an invalid input is ``rejected``; a missing
    tool or a registry scope violation is ``failed``."""
    tools = registry.filter("enabled").select("task", "endpoint", F.col("required_scope").alias("__need"))
    joined = queries.join(tools, "task", "left")
    refused = F.col("reject_reason").isNotNull()
    no_tool, wrong = F.col("endpoint").isNull(), F.col("__need") != F.col("input_scope")
    status = (
        F.when(refused, F.lit("rejected"))
        .when(no_tool | F.coalesce(wrong, F.lit(False)), F.lit("failed"))
        .when(F.size("image_ids") > 2, F.lit("rejected"))
        .otherwise(F.lit("dispatched"))
    )
    error = (
        F.when(refused, F.col("reject_reason"))
        .when(no_tool, F.concat(F.lit("no enabled tool for "), F.col("task")))
        .when(wrong, F.concat(F.col("task"), F.lit(" requires "), F.col("__need")))
        .when(F.size("image_ids") > 2, F.lit("maximum of two images is supported"))
    )
    return joined.withColumns({"status": status, "error": error}).drop("__need")


def trace_events(dispatched: DataFrame) -> DataFrame:
    """The events each dispatched query leaves, one row per step."""
    s, refused = F.col("status"), F.col("reject_reason").isNotNull()
    failed = s == "failed"
    bad_input = ~refused & (s == "rejected")
    done = s == "dispatched"

    def ev(state: str, status: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(state).alias("state"), F.lit(status).alias("status")))

    events = F.array_compact(
        F.array(
            ev("QUERY_RECEIVED", "success", F.lit(True)),
            ev("CLASSIFY", "failed", refused), ev("CLASSIFY", "success", ~refused),
            ev("EXECUTION", "failed", failed),
            ev("TOOL_SELECTED", "success", bad_input | done),
            ev("VALIDATE_INPUT", "started", bad_input | done), ev("VALIDATE_INPUT", "failed", bad_input),
            ev("VALIDATE_INPUT", "success", done),
            ev("ML_EXECUTE", "started", done), ev("ML_EXECUTE", "success", done),
            ev("CONFIDENCE", "started", done), ev("CONFIDENCE", "success", done),
            ev("TRACE_FINALIZED", "success", done),
        )
    )
    return dispatched.select("request_id", F.posexplode(events).alias("pos", "e")).select(
        "request_id", (F.col("pos") + 1).alias("step"), "e.state", "e.status"
    )


EVENT_FIELDS = ["block", "message", "endpoint", "details"]


def lifecycle_events(runs: DataFrame) -> DataFrame:
    """The events of whole requests with all their fields, one row per step.

    ``runs``: dispatched queries (see ``dispatch``) with ml_status, ml_error, model_version, score and disagreement of those that a
    tool answered. Details are JSON objects. A tool that fails leaves its own failed event and one for the request.
    """
    c = F.col
    refused, failed = c("reject_reason").isNotNull(), c("status") == "failed"
    bad_input, done = ~refused & (c("status") == "rejected"), c("status") == "dispatched"
    good = done & (F.coalesce("ml_status", F.lit("success")) == "success")
    broken = done & ~good
    none = F.lit(None).cast("string")

    def text_of(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("")) for x in parts])

    def event(when: Column, state: str, status: str, message: Column, tool: bool = False, **details: Column) -> Column:
        named = F.to_json(F.struct(*[v.alias(k) for k, v in details.items()])) if details else F.lit("{}")
        return F.when(when, F.struct(
            F.lit(state).alias("state"), F.lit(status).alias("status"), (c("task") if tool else none).alias("block"),
            message.alias("message"), (c("endpoint") if tool else none).alias("endpoint"), named.alias("details"),
        ))

    fault = F.coalesce("ml_error", F.lit("tool failed"))
    events = F.array_compact(F.array(
        event(F.lit(True), "QUERY_RECEIVED", "success", F.lit("accepted"), query_length=F.length(F.coalesce("query", F.lit("")))),
        event(refused, "CLASSIFY", "failed", c("reject_reason")),
        event(~refused, "CLASSIFY", "success", text_of("classified as ", c("task")), task=c("task")),
        event(failed, "EXECUTION", "failed", c("error")),
        event(bad_input | done, "TOOL_SELECTED", "success", text_of("selected ", c("task")), tool=True),
        event(bad_input | done, "VALIDATE_INPUT", "started", F.lit("validating")),
        event(bad_input, "VALIDATE_INPUT", "failed", c("error"), reasons=c("error")),
        event(done, "VALIDATE_INPUT", "success", F.lit("input accepted")),
        event(done, "ML_EXECUTE", "started", text_of("calling ", c("task")), tool=True),
        event(broken, "ML_EXECUTE", "failed", fault, tool=True),
        event(good, "ML_EXECUTE", "success", text_of(c("task"), " completed"), tool=True, model_version=c("model_version")),
        event(good, "CONFIDENCE", "started", F.lit("weighing confidence")),
        event(good, "CONFIDENCE", "success", text_of("final confidence ", F.format_string("%.3f", "score")), disagreement=c("disagreement")),
        event(good, "TRACE_FINALIZED", "success", F.lit("trace completed")),
        event(broken, "EXECUTION", "failed", fault),
    ))
    rows = runs.select("request_id", F.posexplode(events).alias("pos", "e"))
    return rows.select("request_id", (F.col("pos") + 1).alias("step"), "e.*")


def trace_aggregates(columns: list[str]) -> list[Column]:
    fields = ["step", "state", "status", *[f for f in EVENT_FIELDS if f in columns]]
    failed = F.col("status") == "failed"
    return [
        F.sort_array(F.collect_list(F.struct(*fields))).alias("events"), F.count(F.lit(1)).alias("n_events"),
        F.min_by("state", F.when(failed, F.col("step"))).alias("failing_state"), F.max_by("state", "step").alias("last_state"),
        F.bool_or(failed & (F.col("state") == "EXECUTION")).alias("broke"),
    ]


def with_final_status(traces: DataFrame) -> DataFrame:
    final = (
        F.when(F.col("broke"), F.lit("failed"))
        .when(F.col("failing_state").isNotNull(), F.lit("rejected"))
        .when(F.col("last_state") == "TRACE_FINALIZED", F.lit("success"))
        .otherwise(F.lit("running"))
    )
    return traces.withColumn("final_status", final).drop("broke")


def assemble_traces(events: DataFrame) -> DataFrame:
    """Ordered path, final status and first failing state of each request.

    Every event counts, repeated ones too; those that carry further fields (``EVENT_FIELDS``) keep them. The trace of a
    request is the result itself, so its events meet in one row.
    """
    return with_final_status(events.groupBy("request_id").agg(*trace_aggregates(events.columns)))
