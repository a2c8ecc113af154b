"""Exact quotas, hot keys and order independence against brute force on small inputs."""

import hashlib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eoframe.config import HealthConfig
from eoframe.functions.positions import in_file_order, with_positions
from eoframe.functions.ranking import keep_first, keep_first_by
from eoframe.operators import health as hl
from eoframe.operators import imagery as im
from eoframe.operators import pairs as tp
from eoframe.operators import sampling as sm


def by_hash(keys, seed):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


@pytest.fixture(scope="module")
def keyed(spark):
    """One stratum holds two thirds of the rows; one stratum is null."""
    return spark.range(3000).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"),
        F.when(F.col("id") % 3 != 0, F.lit("hot")).when(F.col("id") % 2 == 0, F.lit("cold")).alias("stratum"),
    )


@pytest.mark.parametrize("limit", [0, 1, 137, 3000, 5000])
def test_first_rows_are_the_first_by_hash(keyed, limit):
    got = {r["key"] for r in keep_first(keyed, 7, "key", limit, digits=1).collect()}
    assert got == set(by_hash([f"k{i}" for i in range(3000)], 7)[:limit])


def test_strata_quotas_with_null_and_unlimited_strata(spark, keyed):
    limits = spark.createDataFrame([("hot", 100), (None, 5)], "stratum string, limit bigint")
    got = keep_first_by(keyed, 7, "key", ["stratum"], limits).groupBy("stratum").count().collect()
    assert {r["stratum"]: r["count"] for r in got} == {"hot": 100, None: 5}
    everything = spark.createDataFrame([("cold", None)], "stratum string, limit bigint")
    assert keep_first_by(keyed, 7, "key", ["stratum"], everything).count() == 500


def test_splits_are_complete_disjoint_and_independent_of_partitioning(keyed):
    parts = [("train", 0.7), ("val", 0.15)]
    a = {r["key"]: r["split"] for r in sm.split_rows(keyed.repartition(1), 3, "key", parts, "test").collect()}
    b = {r["key"]: r["split"] for r in sm.split_rows(keyed.repartition(13), 3, "key", parts, "test").collect()}
    assert a == b and len(a) == 3000
    assert [list(a.values()).count(s) for s in ("train", "val", "test")] == [2100, 450, 450]


def test_small_split_gives_val_everything_it_asks_for(spark):
    df = spark.range(5).select(F.col("id").cast("string").alias("key"))
    assert {r["split"] for r in sm.split_rows(df, 3, "key", [("val", 0.15)], "train", floor=20).collect()} == {"val"}


def test_quota_order_of_operations(spark):
    """29 of 100 patches with N = 100: multiply first gives 29, divide first gives 28 and one is topped up."""
    rows = [(str(i), f"p{i}", "A" if i < 29 else "B") for i in range(100)]
    ann = spark.createDataFrame(rows, "ann_id string, patch_id string, country string")
    assert sm.sample_patches_v1(ann, 100, 1).count() == 100
    drawn = sm.sample_patches_v2(ann, 100, 1)
    assert drawn.count() == 100 and drawn.select("patch_id").distinct().count() == 100


def test_hot_location_pairs_equal_brute_force(spark):
    rows = [(f"S2A_M_2017{1 + i % 12:02d}{1 + i // 12:02d}T000000_N_R_T1_0_0",) for i in range(60)] + [("S2A_M_20170101T000000_N_R_T1_0_1",)]
    patches = tp.parse_patch_id(spark.createDataFrame(rows, "patch_id string"))
    got = {(r["patch_id_t1"], r["patch_id_t2"]) for r in tp.temporal_pairs(patches, block=7).collect()}
    hot = [r[0] for r in rows[:60]]
    want = {(a, b) if a.split("_")[2] < b.split("_")[2] else (b, a) for a, b in itertools.combinations(hot, 2) if a.split("_")[2] != b.split("_")[2]}
    assert got == want and len(got) == tp.temporal_pairs(patches, block=7).count()


@pytest.mark.parametrize("seed", range(4))
def test_chunked_health_equals_sequential_replay(spark, seed):
    rng, ts, rows = random.Random(seed), 0, []
    for i in range(1500):
        ts += rng.choice([0, 300, 900, 2500, 12_000 if rng.random() < 0.1 else 100])
        rows.append((rng.choice([1, 1, 1, 2]), i, ts, int(rng.random() > 0.45)))
    calls = spark.createDataFrame(rows, "service bigint, event_id bigint, ts_ms bigint, ok int")
    got = {r["event_id"]: (r["decision"], r["state"], r["transition"])
           for r in hl.service_health(calls, chunk=rng.choice([1, 7, 50]), fan=rng.choice([2, 3, 16])).collect()}
    cfg, want = HealthConfig(), {}
    for _, part in pd.DataFrame(rows, columns=["service", "event_id", "ts_ms", "ok"]).groupby("service"):
        out, _, _ = hl.replay(part, 0, 0, cfg.failure_threshold, cfg.recovery_ms)
        want |= {r.event_id: (r.decision, r.state, r.transition) for r in out.itertuples()}
    assert got == want and any(d == "rejected" for d, _, _ in got.values())


def test_three_failures_open_and_success_after_pause_closes():
    log = pd.DataFrame({"service": 1, "event_id": range(5), "ts_ms": [0, 1, 2, 9000, 10_002], "ok": [0, 0, 0, 1, 1]})
    out, state, _ = hl.replay(log, 0, 0, 3, 10_000)
    assert out["decision"].tolist() == ["executed"] * 3 + ["rejected", "executed"] and state == 0


def test_gather_takes_the_payload_held_at_completion(spark):
    rows = [("p", "A", "a1", 1), ("p", "A", "a2", 2), ("p", "B", "b1", 3), ("p", "A", "a3", 4), ("q", "A", "x", 5), ("p", "Z", "z", 1)]
    df = spark.createDataFrame(rows, "k string, band string, payload string, pos bigint")
    got = im.gather_complete(df, "k", "band", "payload", "pos", ["A", "B"]).collect()
    assert len(got) == 1 and got[0]["completed_at"] == 3 and [i["payload"] for i in got[0]["items"]] == ["a2", "b1"]


def test_member_paths_too_short_or_other_files(spark):
    from eoframe.functions import text

    paths = spark.createDataFrame([("a/b/c.tif",), ("r\\t\\patch\\patch_B02.tif",), ("r/t/p/readme.txt",)], "path string")
    got = [tuple(r) for r in paths.select(text.member_patch(F.col("path"), "parent"), text.member_band(F.col("path"), "parent")).collect()]
    assert [g[0] for g in got] == ["", "patch", ""] and got[1][1] == "B02"


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else f"g{i % 7}") for i in range(40)], "id int, g string")
    out = sm.split_groups(df, 3, "g", [("train", 0.7), ("val", 0.15)], "test")
    assert out.columns == ["id", "g", "split"] and out.count() == 40
    assert out.groupBy("g").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0] == 1


def test_entries_outside_the_universe_are_left_out(spark):
    entries = spark.range(100).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("image"))
    universe = spark.range(45).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("patch_id"))
    out = sm.split_by_patch(entries, 0.2, 3, universe=universe)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"val": 9, "train": 36}


def test_repeated_trace_events_all_count(spark):
    from eoframe.operators import query_log as ql

    events = spark.createDataFrame([("r", 1, "CLASSIFY", "started", "m1"), ("r", 2, "CLASSIFY", "started", "m2"), ("r", 3, "CLASSIFY", "failed", "m3")],
                                   "request_id string, step int, state string, status string, message string")
    trace = ql.assemble_traces(events).first()
    assert trace["n_events"] == 3 and [e["message"] for e in trace["events"]] == ["m1", "m2", "m3"]
    assert (trace["failing_state"], trace["final_status"]) == ("CLASSIFY", "rejected")


def test_draws_do_not_move_wide_rows_by_stratum(spark, keyed, tmp_path):
    keyed.withColumn("wide", F.repeat(F.lit("x"), 50)).write.parquet(str(tmp_path / "t"))
    wide = spark.read.parquet(str(tmp_path / "t"))
    limits = spark.createDataFrame([("hot", 100), (None, 5)], "stratum string, limit bigint")
    plan = keep_first_by(wide, 7, "key", ["stratum"], limits)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_pair_weights_on_a_grid_equal_listed_pairs(spark):
    ids = [f"S2A_M_2017{1 + i % 12:02d}{1 + i // 12:02d}T000000_N_R_T1_0_0" for i in range(40)]
    patches = spark.createDataFrame([(p,) for p in ids], "patch_id string")
    ann = spark.createDataFrame([(p, "land cover", ["a", "b", "a, b"][i % 3]) for i, p in enumerate(ids)], "patch_id string, category string, output string")
    listed = tp.temporal_pairs(tp.parse_patch_id(patches)).count()
    assert tp.pair_weights(ann.withColumn("type", F.lit("binary")).withColumn("input", F.col("output")), patches, block=5).agg(F.sum("weight")).first()[0] == listed


def test_pair_records_keep_every_image_field(spark):
    from eoframe.operators import metadata as md

    image = '{"image_id": "i", "width": 5, "crs": "EPSG:4326", "bands": [{"band_index": 1, "band_id": "VV"}], "extra_metadata": {"a": "b"}}'
    rows = spark.createDataFrame([(f'{{"pair_id": "p", "primary_image": {image}, "secondary_image": {image}}}',)], "payload string")
    r = md.parse_pair_json(rows).first()
    assert (r["primary"]["width"], r["primary"]["crs"], r["secondary"]["bands"][0]["band_id"], r["primary"]["extra_metadata"]) == ("5", "EPSG:4326", "VV", {"a": "b"})


def test_health_of_one_service_in_ten_thousand_chunks(spark):
    """All calls are one service's. No task sees more than ``fan`` transitions, and entries equal a sequential replay."""
    rng, ts, calls, fan = random.Random(9), 0, [], 8
    for i in range(10_000):
        ts += rng.choice([50, 300, 900, 4000, 11_000])
        calls.append((1, i, ts, int(rng.random() > 0.5)))
    cfg = HealthConfig()
    limit, pause = cfg.failure_threshold, cfg.recovery_ms
    rows, want, state, since = [], {}, 0, 0
    for _, i, at, ok in calls:
        want[i] = (state, since)
        rows += [(1, i, at, *r) for r in hl._transitions(np.array([at]), np.array([ok]), limit, pause)]
        state, since, *_ = hl.step(state, since, at, bool(ok), limit, pause)
    table = spark.createDataFrame(rows, hl.TRANSITION)
    got = hl.entry_states(table, limit, pause, fan).collect()
    assert {r["node"]: (r["entry"], r["opened_ms"] if r["entry"] == limit else 0) for r in got} == want
    most = hl.under_parent(table, fan).groupBy("service", "parent").agg(F.countDistinct("node").alias("n")).agg(F.max("n")).first()[0]
    assert most == fan
    whole = itertools.accumulate(hl.Transition.read(table.toPandas(), limit), lambda a, b: a.then(b, pause))
    assert max(len(t.opened) for t in whole) < 250  # as many as calls in one pause, not as calls in the log


def test_transitions_do_not_hang_on_the_order_of_rows(spark):
    """Calls at one time: a pause that ends there ends at the first of them, whatever order a shuffle leaves the rows in."""
    ts, ok = np.array([0, 8000, 8000, 8000]), np.array([0, 0, 1, 0])
    rows = hl._transitions(ts, ok, 3, 10_000)
    assert len({(entry, upto) for entry, upto, *_ in rows}) == len(rows)
    state, since = 3, -5000
    for at, good in zip(ts.tolist(), ok.tolist()):
        state, since, *_ = hl.step(state, since, at, bool(good), 3, 10_000)
    backwards = pd.DataFrame([(1, 0, 0, *r) for r in rows[::-1]], columns=hl._names(hl.TRANSITION))
    assert hl.Transition.read(backwards, 3)[0].apply(3, -5000, 10_000) == (state, since)


@pytest.fixture(scope="module")
def odd_events(tmp_path_factory):
    """Events of few services with equal times; some lack an id, a time, a user or a type."""
    import duckdb

    folder, rng = tmp_path_factory.mktemp("odd"), random.Random(5)
    rows = [(None if rng.random() < 0.05 else i, None if rng.random() < 0.1 else f"2024-01-01 00:{i // 150:02d}:{i % 12:02d}",
             None if rng.random() < 0.05 else rng.randrange(3), rng.choice(["error", "click", "view", None])) for i in range(900)]
    # ids may be absent once at most in a second of a service, as the order of two such calls is open
    seen, kept = set(), []
    for r in rows:
        if r[0] is not None or (r[1], r[2]) not in seen:
            kept.append(r)
            seen |= {(r[1], r[2])} if r[0] is None else set()
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar)")
    con.executemany("insert into events values (?, ?, ?, ?)", kept)
    con.execute(f"copy events to '{folder}/events.parquet' (format parquet)")
    return str(folder), con


@pytest.mark.parametrize("name", ["service_health", "service_health_summary", "health_stream"])
def test_health_of_odd_events_equals_its_sql(spark, odd_events, name):
    from __spark_entry__ import oracle_sql, queries
    from oracle_check import compare

    folder, con = odd_events
    assert compare(queries()[name](spark, folder), con, oracle_sql()[name]) is None


def test_positions_equal_a_plain_sort(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", None, "b"]), rng.choice([None, *range(40)]), i) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, x bigint, i bigint")
    got = {r["i"]: r["pos"] for r in with_positions(df, ["x", "i"], ["g"]).collect()}
    for g in {r[0] for r in rows}:
        order = sorted((r[1] is not None, r[1] or 0, r[2]) for r in rows if r[0] == g)
        assert [got[i] for *_, i in order] == list(range(len(order)))
    assert sorted(r["pos"] for r in with_positions(df, ["x"]).collect()) == list(range(800))


def test_file_order_over_several_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.jsonl").write_text("".join(f'{{"v": {k * 100 + i}}}\n' for i in range(100)))
    rows = in_file_order(spark.read.schema("v bigint").json(str(tmp_path)))
    assert [(r["pos"], r["v"]) for r in rows.orderBy("pos").collect()] == [(i, i) for i in range(300)]


def test_gather_with_many_repeats_before_and_after_completion(spark):
    """Only where an item came three times and went on after completion do first and last not tell the held payload."""
    rows = [("p", "A", f"a{i}", i) for i in range(1, 9)] + [("p", "B", "b", 5), ("q", "A", "x", 1), ("q", "B", "y", 2), ("q", "B", "y3", 3), ("r", "A", "z", 1)]
    df = spark.createDataFrame(rows, "k string, band string, payload string, pos bigint")
    got = {r["k"]: (r["completed_at"], [i["payload"] for i in r["items"]]) for r in im.gather_complete(df, "k", "band", "payload", "pos", ["A", "B"]).collect()}
    assert got == {"p": (5, ["a5", "b"]), "q": (2, ["x", "y"])}


def rows_shuffled(df):
    """Rows that the exchanges of the executed plan wrote."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
    return total


def test_audit_and_counts_shuffle_a_row_for_a_patch(spark):
    from eoframe.operators import pixels

    px = spark.range(100).selectExpr("concat('p', id) as patch_id", "explode(array('B01', 'B02', 'B8A', 'B09', 'zz', 'B02')) as band").coalesce(1)
    audit = pixels.preprocessing_audit(px)
    assert rows_shuffled(audit) <= 100
    row = audit.where("patch_id = 'p7'").first()
    assert (row.bands_used, row.bands_dropped) == (["B02", "B8A"], ["B01", "B09"])
    assert row.drop_reasons == [f"{b}: excluded by native resolution 60 m" for b in ("B01", "B09")]
    counts = px.groupBy("patch_id").agg(im.count_items("band", ["B02", "B8A", "B12"]).alias("n"))
    assert rows_shuffled(counts) <= 100 and {r.n for r in counts.collect()} == {2}


def test_file_order_shuffles_no_rows(spark, tmp_path):
    spark.range(3000).selectExpr("id AS v").repartition(5).write.json(str(tmp_path / "rows"), compression="lz4")
    df = in_file_order(spark.read.schema("v bigint").json(str(tmp_path / "rows")))
    assert sorted(r["pos"] for r in df.collect()) == list(range(3000))
    assert "rangepartitioning" not in df._jdf.queryExecution().executedPlan().toString()
