"""Traces of arriving events against the batch, full reports on odd inputs, rows paired by position."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eoframe.functions import geometry
from eoframe.operators import lifecycle as lc
from eoframe.operators import metrics as mt
from eoframe.operators import query_log as ql
from eoframe.operators import reconcile as rc
from eoframe.sources import writers
from eoframe.streaming.runtime import run_to_parquet
from eoframe.streaming.traces import trace_stream

EVENTS = "request_id string, step int, state string, status string, block string, message string, endpoint string, details string, at timestamp"
START = datetime(2024, 1, 1)


def event(request, step, seconds, state="ML_EXECUTE", status="success"):
    return (request, step, state, status, "vqa", f"m{step}", "/vqa", '{"k":1}', START + timedelta(seconds=seconds))


def test_trace_stream_equals_batch_on_late_and_repeated_events(spark, tmp_path):
    """Events arrive out of order over four batches, some twice; one request is far later and stays open."""
    rng, events = random.Random(3), []
    for r in range(12):
        n = rng.randint(2, 6)
        events += [event(f"r{r}", s, r * 30 + s * 7, "CLASSIFY" if s == 1 and r % 4 == 0 else "EXECUTION" if s == n and r % 3 == 0 else "STEP",
                         "failed" if s == n and r % 3 == 0 else "success") for s in range(1, n + 1)]
    events.append(event("hot", 1, 200))
    events += [event("hot", s, 200 + s % 40) for s in range(2, 150)]
    arriving = [*events, *rng.sample(events, 60)]
    rng.shuffle(arriving)
    for b in range(4):
        spark.createDataFrame(arriving[b::4], EVENTS).coalesce(1).write.parquet(str(tmp_path / f"b{b}"))
    spark.createDataFrame([event("last", 1, 90_000)], EVENTS).coalesce(1).write.parquet(str(tmp_path / "b4"))
    stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = {r.request_id: r for r in run_to_parquet(trace_stream(stream, "20 minutes", "10 minutes"), "t").collect()}
    want = {r.request_id: r for r in ql.assemble_traces(spark.createDataFrame(events, EVENTS)).collect()}
    assert set(got) == set(want) and "last" not in got
    for r, w in want.items():
        assert (got[r].events, got[r].n_events, got[r].final_status, got[r].failing_state) == (w.events, w.n_events, w.final_status, w.failing_state)
    assert got["r1"].events[0].details == '{"k":1}' and got["hot"].n_events == 149


def lifecycle(spark, requests, answers):
    rows = spark.createDataFrame(requests, "request_id string, query string, input_scope string, task_hint string, image_ids array<string>")
    told = spark.createDataFrame(
        answers, "request_id string, ml_status string, ml_error string, model_version string, model_confidence double, "
        "cross_modal_agreement double, input_quality double, ml_disagreement boolean")
    runs = lc.run_requests(rows, ql.registry_table(rows), told)
    return {r.request_id: r for r in runs.collect()}, {r.request_id: r for r in lc.request_traces(runs).collect()}, lc.request_records(runs, "now").collect()


def test_lifecycle_of_single_requests(spark):
    one = ["i"]
    requests = [("ok", "Is there water?", "single", None, one), ("split", "Is there water?", "single", None, one),
                ("scope", "what changed", "single", "change", one), ("many", "Is there water?", "single", None, ["a", "b", "c"]),
                ("broke", "Is there water?", "single", None, one), ("silent", None, "single", None, None)]
    answers = [("ok", "success", None, "v1", 0.9, 0.9, 0.9, None), ("ok", "success", None, "v1", 0.9, 0.9, 0.9, None),
               ("split", "success", None, None, 0.5, 0.3, None, None), ("broke", "error", None, None, None, None, None, None),
               ("many", "success", None, None, 1.0, 1.0, 1.0, None), ("unasked", "success", None, None, 1.0, 1.0, 1.0, None)]
    runs, traces, records = lifecycle(spark, requests, answers)
    assert {k: r.final_status for k, r in runs.items()} == {
        "ok": "success", "split": "success", "scope": "rejected", "many": "rejected", "broke": "failed", "silent": "running"}
    assert (runs["ok"].score, runs["ok"].disagreement) == (0.9, False) and runs["split"].disagreement and runs["many"].score is None
    assert {k: (t.n_events, t.failing_state) for k, t in traces.items()} == {
        "ok": (10, None), "split": (10, None), "scope": (2, "CLASSIFY"), "many": (5, "VALIDATE_INPUT"), "broke": (8, "ML_EXECUTE")}
    assert traces["ok"].events[0].details == '{"query_length":15}' and traces["ok"].events[5].endpoint == "/vqa"
    assert sorted(r.request_id for r in records) == ["ok", "split"]


BOX = "struct<min_x:double,min_y:double,max_x:double,max_y:double,label:string,confidence:double>"
OUT = f"request_id string, position bigint, model_name string, prediction string, pred_kind string, confidence double, boxes array<{BOX}>, provenance_id string"


def test_reports_with_every_field(spark):
    rows = [("two", 2, "b", "Water, road", "text", None, None, ""), ("two", 1, "a", "water", "text", 0.5, None, "p1"),
            ("same", 1, "m", "x", "text", 0.1, None, None), ("same", 2, "m", "x", "text", 0.2, None, "p2"), ("one", 1, "m", None, "none", None, None, None)]
    asked = spark.createDataFrame([(r,) for r in ("two", "same", "one", "silent")], "request_id string")
    got = {r.request_id: r for r in rc.full_reports(asked, spark.createDataFrame(rows, OUT)).collect()}
    assert got["two"].participating_models == ["a", "b"] and got["two"].provenance_refs == ["p1"]
    assert got["two"].individual_confidences == {"a": 0.5, "b": None} and got["two"].comparison_summary == "2 outputs: PARTIAL_AGREEMENT"
    assert got["same"].individual_confidences == {"m": 0.2} and got["same"].participating_models == ["m", "m"]
    assert got["one"].individual_predictions == {"m": None} and got["one"].comparison_summary == "single output of m"
    assert (got["silent"].status, got["silent"].participating_models, got["silent"].comparison_summary) == ("INSUFFICIENT_INFORMATION", [], "no outputs")


def test_pairs_skip_boxes_without_a_partner(spark):
    a = [(0.0, 0.0, 1.0, 1.0, "Road", 0.5), (5.0, 5.0, 6.0, 6.0, "x", 0.5), (9.0, 9.0, 10.0, 10.0, "y", 0.5)]
    b = [(9.0, 9.0, 10.0, 10.0, "z", 0.4), (0.0, 0.0, 1.0, 0.9, "road", 0.4)]
    df = spark.createDataFrame([(a, b)], f"a array<{BOX}>, b array<{BOX}>")
    pairs = df.select(geometry.match_boxes(F.col("a"), F.col("b")).alias("m")).first().m.matched_pairs
    assert [(p.box_a.label, p.box_b.label, p.iou, p.labels_match) for p in pairs] == [("Road", "road", 0.9, True), ("y", "z", 1.0, False)]


@pytest.mark.parametrize("more", [0, 7])
def test_rows_are_paired_by_position(spark, tmp_path, more):
    for name, n, parts in (("p", 500 + more, 3), ("r", 500, 5)):
        rows = spark.range(n).select("id", F.concat(F.lit(name), F.col("id").cast("string")).alias(name)).repartition(parts)
        writers.write_ordered(rows, str(tmp_path / name), ["id"])
    read = {n: spark.read.schema(f"{n} string").json(str(tmp_path / n)) for n in ("p", "r")}
    got = {r.pos: (r.p, r.r) for r in mt.align_by_position(read["p"], read["r"]).collect()}
    assert got == {i: (f"p{i}", f"r{i}" if i < 500 else None) for i in range(500 + more)}
