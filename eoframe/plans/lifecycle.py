"""Requests from query to trace, traces of arriving events, full reports, and files zipped by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe.functions import geometry
from eoframe.operators import lifecycle as lc
from eoframe.operators import metrics as mt
from eoframe.operators import query_log as ql
from eoframe.operators import reconcile as rc
from eoframe.operators import validation as va
from eoframe.plans import quality as quality_plans
from eoframe.plans.registry import query
from eoframe.plans.requests import DISPATCHED, _registry, requests
from eoframe.plans.streams import StreamTables
from eoframe.session import shared_dir
from eoframe.sources import writers
from eoframe.sources.adapters import Tables, oracle
from eoframe.streaming.runtime import run_to_parquet
from eoframe.streaming.traces import trace_stream as traces_of

# What the tools answered, by the numbers in a request's id: some fail, some never answer, some disagree.
_C = "cast(split_part(request_id, '-', 1) as bigint)"
_T = "cast(split_part(request_id, '-', 2) as bigint)"


def _answers(t: Tables) -> DataFrame:
    c, k = (F.split_part(F.col("request_id"), F.lit("-"), F.lit(i)).cast("bigint") for i in (1, 2))
    return t.requests.where(~((c % 23 == 7) & (k % 3 == 1))).select(
        "request_id", F.when(c % 19 == 3, F.lit("error")).otherwise(F.lit("success")).alias("ml_status"),
        F.when((c % 19 == 3) & (k % 2 == 0), F.lit("out of memory")).alias("ml_error"),
        F.when(c % 4 != 0, F.concat(F.lit("m-"), (c % 4).cast("string"))).alias("model_version"),
        F.when(c % 5 != 0, (c % 100).cast("double") / 100).alias("model_confidence"),
        F.when(k % 2 == 0, (c % 10).cast("double") / 10).alias("cross_modal_agreement"),
        F.when(c % 7 != 0, F.lit(0.5)).alias("input_quality"), (c % 13 == 1).alias("ml_disagreement"),
    )


_RUNS = f"""with {DISPATCHED}, n as (select *, {_C} as c, {_T} as k from dispatched),
    m as (select *, status = 'dispatched' and not (c % 23 = 7 and k % 3 = 1) as answered, c % 19 = 3 as broken,
      case when c % 5 <> 0 then (c % 100)::double / 100 else 0.75e0 end as mc, case when k % 2 = 0 then (c % 10)::double / 10 else 1e0 end as ag,
      case when c % 7 <> 0 then 0.5e0 else 0.9e0 end as iq from n),
    runs as (select *, case when status <> 'dispatched' then status when not answered then 'running' when broken then 'failed' else 'success' end as final_status,
      case when answered and not broken then round(0.55e0 * mc + 0.25e0 * ag + 0.2e0 * iq, 4) end as score,
      case when answered and not broken then ag < 0.6e0 or c % 13 = 1 end as disagreement,
      case when answered and broken then case when k % 2 = 0 then 'out of memory' else 'tool failed' end end as fault from m)"""
_OPEN = "QUERY_RECEIVED:success>CLASSIFY:"
_TOOL = f"{_OPEN}success>TOOL_SELECTED:success>VALIDATE_INPUT:started>VALIDATE_INPUT:"
_CALL = f"{_TOOL}success>ML_EXECUTE:started>ML_EXECUTE:"


@query(oracle(_RUNS + f""" select request_id, task, final_status, score, disagreement, fault as tool_error, case when final_status = 'success' then 'request-controller' end as controller,
      case when final_status = 'success' and c % 4 <> 0 then 'm-' || cast(c % 4 as varchar(2)) end as model_version,
      case when final_status = 'running' then null when refused then '{_OPEN}failed' when status = 'failed' then '{_OPEN}success>EXECUTION:failed'
        when status = 'rejected' then '{_TOOL}failed' when broken then '{_CALL}failed>EXECUTION:failed'
        else '{_CALL}success>CONFIDENCE:started>CONFIDENCE:success>TRACE_FINALIZED:success' end as path,
      case when final_status = 'running' then null when refused then 'CLASSIFY' when status = 'failed' then 'EXECUTION' when status = 'rejected' then 'VALIDATE_INPUT'
        when broken then 'ML_EXECUTE' end as failing_state,
      case when final_status = 'success' then task || ' ' || endpoint end as called from runs""", "requests"))
def request_lifecycle(t: Tables) -> DataFrame:
    """Every request through intent, scope, dispatch, answer, confidence, provenance and trace."""
    rows = requests(t)
    runs = lc.run_requests(rows, _registry(rows), _answers(t))
    records = lc.request_records(runs, "2024-01-01T00:00:00+00:00").select("request_id", "controller", F.col("model_version").alias("used"))
    traces = lc.request_traces(runs)
    path = F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["state"], e["status"])), ">")
    call = F.filter("events", lambda e: (e["state"] == "ML_EXECUTE") & (e["status"] == "success"))
    traces = traces.select(
        "request_id", path.alias("path"), "failing_state", F.col("final_status").alias("traced"),
        F.get(F.transform(call, lambda e: F.concat_ws(" ", e["block"], e["endpoint"])), F.lit(0)).alias("called"),
    )
    joined = runs.join(records, "request_id", "left").join(traces, "request_id", "left")
    tool = F.when(F.col("ml_status") == "error", F.when(F.col("status") == "dispatched", F.col("error")))
    return joined.where("traced is null or traced = final_status").select(
        "request_id", "task", "final_status", "score", "disagreement", tool.alias("tool_error"), "controller",
        F.col("used").alias("model_version"), "path", "failing_state", "called",
    )


@query(oracle(_RUNS + f""", last as (select max(c) as most from runs where final_status <> 'running')
    select request_id, final_status, case when refused then 2 when status = 'failed' then 3 when status = 'rejected' then 5 when broken then 8 else 10 end as n_events,
      case when final_status = 'success' then '{{"query_length":' || cast(length(query) as varchar(10)) || '}}' end as first_details,
      case when final_status = 'success' then task || ' completed' when status = 'dispatched' then fault end as told
    from runs join requests using (request_id), last where final_status <> 'running' and c <> most""", "requests"))
def trace_stream(t: Tables) -> DataFrame:
    """The same events as a stream, an hour apart by conversation, every third one sent twice. The last hour's stay open."""
    streamed = StreamTables(t, "conversations")
    rows = requests(streamed)
    runs = lc.run_requests(rows, _registry(t.nation), _answers(t)).where("final_status <> 'running'")
    c, k = (F.split_part(F.col("request_id"), F.lit("-"), F.lit(i)).cast("bigint") for i in (1, 2))
    at = F.timestamp_seconds(c * 3600 + k * 20 + F.col("step"))
    events = ql.lifecycle_events(runs).withColumn("at", at)
    events = events.withColumn("copy", F.explode(F.when(F.col("step") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")
    traces = run_to_parquet(traces_of(events), "traces")
    told = F.filter("events", lambda e: (e["state"] == "ML_EXECUTE") & (e["status"] != "started"))
    good = F.col("final_status") == "success"
    return traces.select(
        "request_id", "final_status", "n_events", F.when(good, F.get("events", F.lit(0))["details"]).alias("first_details"),
        F.get(told, F.lit(0))["message"].alias("told"),
    )


@query(oracle(f"""with {quality_plans.REPORTS}, s as (select *, row_number() over (partition by request_id order by position, model_name, prediction) as rk from outputs),
    w as (select *, row_number() over (partition by request_id, model_name order by rk desc) = 1 as last from s),
    g as (select request_id, string_agg(model_name, ',' order by rk) as models, string_agg(model_name || '=' || prediction || '@' || cast(round(confidence, 4) as varchar(20)), ',' order by model_name) filter (where last) as said,
      string_agg('prov-' || cast(sk as varchar(20)), ',' order by rk) filter (where sk % 3 = 0) as refs, arg_min(model_name, rk) as first_model from w group by request_id)
    select cast(o_orderkey as varchar(20)) as request_id, coalesce(status, 'INSUFFICIENT_INFORMATION') as status, coalesce(models, '') as models, coalesce(said, '') as said, coalesce(refs, '') as refs,
      case when n_outputs is null then 'no outputs' when n_outputs = 1 then 'single output of ' || first_model else cast(n_outputs as varchar(10)) || ' outputs: ' || status end as summary
    from orders left join reports on cast(o_orderkey as varchar(20)) = request_id left join g using (request_id)""", "outputs"))
def disagreement_reports(t: Tables) -> DataFrame:
    """Reports with all fields, of orders without any output, too."""
    outputs = quality_plans._outputs(t).withColumn("provenance_id", F.when(F.col("sk") % 3 == 0, F.concat(F.lit("prov-"), F.col("sk").cast("string"))))
    out = rc.full_reports(t.orders.select(F.col("o_orderkey").cast("string").alias("request_id")), outputs)
    conf = F.col("individual_confidences")
    said = F.transform(F.array_sort(F.map_entries("individual_predictions")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"], F.lit("@"), F.round(F.element_at(conf, e["key"]), 4).cast("string")))
    return out.select(
        "request_id", "status", F.array_join("participating_models", ",").alias("models"), F.array_join(said, ",").alias("said"),
        F.array_join("provenance_refs", ",").alias("refs"), F.col("comparison_summary").alias("summary"))


@query(oracle(f"""with {quality_plans._MATCH} select ann_id, concat_ws(';', case when got1 = 1 then '1-' || cast(m1 as varchar(2)) || ':' || cast(round(greatest(i11, i12), 4) as varchar(20)) || ':' || case when m1 = 1 then 'true' else 'false' end end,
      case when got2 = 1 then '2-' || case when j2 > j1 then '2' else '1' end || ':' || cast(round(greatest(j1, j2), 4) as varchar(20)) || ':false' end) as pairs from matched""", "detections"))
def matched_pairs(t: Tables) -> DataFrame:
    """The pairs behind the counts: which boxes, how well, and whether their labels agree."""
    lists = quality_plans._box_lists(t)
    out = lists.select("ann_id", "a", "b", geometry.match_boxes(F.col("a"), F.col("b"), 0.5).alias("m"))
    pairs = F.transform("m.matched_pairs", lambda p: F.concat_ws(
        ":", F.concat_ws("-", F.array_position("a", p["box_a"]).cast("string"), F.array_position("b", p["box_b"]).cast("string")),
        p["iou"].cast("string"), p["labels_match"].cast("string")))
    return out.select("ann_id", F.array_join(pairs, ";").alias("pairs"))


@query(oracle(f"""with {quality_plans._CONF} select ann_id, round(mt, 4) as model_confidence, round(agt, 4) as agreement_score, round(ql, 4) as input_quality_score, round({quality_plans._c('fin')}, 4) as final_confidence,
      round(cl, 4) as cloud, case when oc is not null then {quality_plans._c('oc')} end as optical, case when sc is not null then {quality_plans._c('sc')} end as sar,
      case when oc is null and sc is null and rw is not null then {quality_plans._c('rw')} end as raw, case when oc is null and sc is null and rw is null then true end as assumed,
      pen as penalty, '1.0.0' as version from k3""", "detections"))
def confidence_records(t: Tables) -> DataFrame:
    out = rc.confidence_report(quality_plans.confidence_inputs(t))
    k = "confidence_components"
    return out.select(
        "ann_id", "model_confidence", "agreement_score", "input_quality_score", "final_confidence", F.col(f"{k}.cloud_quality_factor").alias("cloud"),
        F.col(f"{k}.optical_model_confidence").alias("optical"), F.col(f"{k}.sar_model_confidence").alias("sar"),
        F.col(f"{k}.raw_model_confidence").alias("raw"), F.col(f"{k}.model_confidence_assumed_default").alias("assumed"),
        F.col("disagreement_penalty_applied").alias("penalty"), F.col("confidence_method_version").alias("version"))


@query(oracle(f"""with {quality_plans._PAIRS} select pair_id, round(case when length(pair_id) % 2 = 0 then 0.25e0 else iou end, 6) as iou,
      case when pair_type <> 'OPTICAL_SAR' then length(pair_id)::double end as days, 'unverified' as status from ab""", "images", "image_pairs"))
def pair_facts(t: Tables) -> DataFrame:
    """Pairs of which some bring their own overlap, and temporal ones their days."""
    n = F.length("pair_id")
    pairs = t.image_pairs.withColumns({
        "spatial_overlap_iou": F.when(n % 2 == 0, F.lit(0.25)),
        "temporal_baseline_days": F.when(F.col("pair_type") != "OPTICAL_SAR", n.cast("double")),
    })
    out = va.assemble_pairs(pairs, t.image_records)
    return out.select("pair_id", F.round("spatial_overlap_iou", 6).alias("iou"), F.col("temporal_baseline_days").alias("days"),
                      F.col("co_registration_status").alias("status"))


@query(oracle("select row_number() over (order by ann_id) - 1 as pos, prediction, reference from pred", "pred"))
def zipped_predictions(t: Tables) -> DataFrame:
    """Predictions and references in two folders of files without any id, paired by where they stand."""
    rows, paths = t.pred.select("ann_id", "prediction", "reference"), {}
    for name in ("prediction", "reference"):
        paths[name] = shared_dir(t.spark, name)
        writers.write_ordered(rows.select("ann_id", name), paths[name], ["ann_id"])
    read = {name: t.spark.read.schema(f"{name} string").json(path) for name, path in paths.items()}
    return mt.align_by_position(read["prediction"], read["reference"]).select("pos", "prediction", "reference")
