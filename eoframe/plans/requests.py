"""Query-log queries: admission, intent, dispatch, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv
from eoframe.operators import query_log as ql
from eoframe.plans.registry import contains_sql, query, sql_text
from eoframe.sources.adapters import Tables, oracle


def requests(t: Tables) -> DataFrame:
    n = F.col("n_images")
    ids = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("img-"), i.cast("string")))
    ids = F.when(n == 0, F.array().cast("array<string>")).when(n == 2, F.array(F.lit("img-1"), F.lit(" "))).otherwise(ids)
    return t.requests.withColumn("image_ids", ids)


_Q = r"regexp_replace(regexp_replace(lower(query), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_KEY = "case " + " ".join(f"when {contains_sql('q', w)} then '{task}'" for task, w in fv.INTENT_RULES) + " end"
CLASSIFIED = f"""q0 as (select *, {_Q} as q from requests),
    q1 as (select *, {_KEY} as kw, case when input_scope = 'bi_temporal' and {contains_sql('q', fv.BI_TEMPORAL_WORDS)} then 'change'
      when input_scope = 'cross_modal' or {contains_sql('q', fv.CROSS_MODAL_WORDS)} then 'fusion' end as shortcut from q0),
    q2 as (select *, coalesce(task_hint, shortcut, kw, case when input_scope = 'bi_temporal' then 'change' else 'vqa' end) as task,
      coalesce(task_hint, case when shortcut is null then kw end) as checked from q1),
    classified as (select *, (checked = 'change' and input_scope <> 'bi_temporal') or (checked = 'fusion' and input_scope <> 'cross_modal') as refused from q2)"""
_NEED = "case task when 'change' then 'bi_temporal' when 'fusion' then 'cross_modal' else 'single' end"


@query(oracle(f"""with {CLASSIFIED} select request_id, task, case when coalesce(refused, false) then 'Task ''' || task || ''' is incompatible with input scope ''' || input_scope || ''''
    else 'ok' end as verdict from classified""", "requests"))
def query_intent(t: Tables) -> DataFrame:
    return ql.classify_queries(requests(t)).select("request_id", "task", F.coalesce("reject_reason", F.lit("ok")).alias("verdict"))


def _re(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {sql_text(pattern)})"


@query(oracle(f"""with q as (select *, lower(query) as q, lower(file_names) as f from requests)
    select request_id, case when selected_task <> '' then selected_task when {_re('q', fv.CLIENT_GROUNDING_PATTERN)} then 'grounding'
      when {_re('q', fv.CLIENT_FUSION_PATTERN)} or (({_re('f', fv.CLIENT_RADAR_FILE_PATTERN)} or n_images >= 2) and {_re('q', fv.CLIENT_FUSION_PAIR_PATTERN)})
        or ({_re('f', fv.CLIENT_RADAR_FILE_PATTERN)} and {_re('f', fv.CLIENT_OPTICAL_FILE_PATTERN)}) then 'fusion'
      when n_images >= 2 or {_re('q', fv.CLIENT_CHANGE_PATTERN)} then 'change' when {_re('q', fv.CLIENT_CAPTION_PATTERN)} then 'caption' else 'vqa' end as task
    from q""", "requests"))
def query_intent_client(t: Tables) -> DataFrame:
    rows = t.requests.withColumn("n_files", F.col("n_images"))
    return ql.classify_queries_regex(rows).select("request_id", "task")


@query(oracle("""select request_id, concat_ws(',', case when length(query) < 1 then 'query is empty' end, case when length(query) > 2000 then 'query is too long' end,
      case when n_images = 0 then 'no image id' end, case when n_images = 3 then 'too many image ids' end, case when n_images = 2 then 'blank image id' end) as reasons
    from requests""", "requests"))
def request_admission(t: Tables) -> DataFrame:
    return ql.check_requests(requests(t)).select("request_id", F.array_join("request_reasons", ",").alias("reasons"))


@query(oracle(f"""with {CLASSIFIED} select request_id, concat_ws(',', case when {_NEED} <> input_scope then task || ' requires ' || {_NEED} || ' input scope' end,
      case when n_images = 3 then 'maximum of two images is supported' end) as reasons from classified""", "requests"))
def scope_check(t: Tables) -> DataFrame:
    rows = ql.classify_queries(requests(t))
    return ql.check_scope(rows, ql.registry_table(rows)).select("request_id", F.array_join("scope_reasons", ",").alias("reasons"))


def _registry(df: DataFrame) -> DataFrame:
    """The registry with the caption tool switched off, so that a missing tool occurs."""
    return ql.registry_table(df).withColumn("enabled", F.col("task") != "caption")


DISPATCHED = f"""{CLASSIFIED}, dispatched as (select request_id, task, case when coalesce(refused, false) then 'rejected' when task = 'caption' or {_NEED} <> input_scope then 'failed'
      when n_images = 3 then 'rejected' else 'dispatched' end as status, coalesce(refused, false) as refused,
      case when task = 'caption' then 'none' else '/' || task end as endpoint from classified)"""


@query(oracle(f"with {DISPATCHED} select request_id, task, status, endpoint from dispatched", "requests"))
def tool_dispatch(t: Tables) -> DataFrame:
    rows = ql.classify_queries(requests(t))
    return ql.dispatch(rows, _registry(rows)).select("request_id", "task", "status", F.coalesce("endpoint", F.lit("none")).alias("endpoint"))


@query(oracle(f"""with {DISPATCHED} select request_id, case when status = 'dispatched' then 'success' else status end as final_status,
      case when refused then 'CLASSIFY' when status = 'failed' then 'EXECUTION' when status = 'rejected' then 'VALIDATE_INPUT' else 'none' end as failing_state,
      case when refused then 2 when status = 'failed' then 3 when status = 'rejected' then 5 else 10 end as n_events,
      case when refused then 'QUERY_RECEIVED:success>CLASSIFY:failed' when status = 'failed' then 'QUERY_RECEIVED:success>CLASSIFY:success>EXECUTION:failed'
        when status = 'rejected' then 'QUERY_RECEIVED:success>CLASSIFY:success>TOOL_SELECTED:success>VALIDATE_INPUT:started>VALIDATE_INPUT:failed'
        else 'QUERY_RECEIVED:success>CLASSIFY:success>TOOL_SELECTED:success>VALIDATE_INPUT:started>VALIDATE_INPUT:success>ML_EXECUTE:started>ML_EXECUTE:success>'
          || 'CONFIDENCE:started>CONFIDENCE:success>TRACE_FINALIZED:success' end as path from dispatched""", "requests"))
def execution_traces(t: Tables) -> DataFrame:
    rows = ql.classify_queries(requests(t))
    traces = ql.assemble_traces(ql.trace_events(ql.dispatch(rows, _registry(rows))))
    path = F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["state"], e["status"])), ">")
    return traces.select("request_id", "final_status", F.coalesce("failing_state", F.lit("none")).alias("failing_state"), "n_events", path.alias("path"))
