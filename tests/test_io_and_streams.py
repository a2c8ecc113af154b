"""Files in and out, and streams equal to their batch twins."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from eoframe.functions import text
from eoframe.operators import annotations as an
from eoframe.operators import provenance as pv
from eoframe.sources import readers, writers
from eoframe.streaming import gather, health
from eoframe.streaming.runtime import run_batches, run_to_parquet, table_stream


def test_jsonl_round_trip_by_split(spark, tmp_path):
    ann = spark.createDataFrame([("1", "p1", "s", "q?", "yes", "binary"), ("2", "p2", "s", None, "t", "captioning")],
                                "ann_id string, patch_id string, s1_name string, input string, output string, type string")
    entries = an.format_instructions(ann).withColumn("split", F.when(F.col("image") == "p1", "train").otherwise("val"))
    writers.write_jsonl(entries, str(tmp_path / "d"))
    back = readers.read_instructions(spark, str(tmp_path / "d" / "split=train"))
    row = back.first()
    assert back.count() == 1 and row["image"] == "p1" and row["conversations"][1]["value"] == "yes"


def test_manifest_array_and_report(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps([{"patch_id": "a", "s1_name": "x"}, {"patch_id": "b"}], indent=2))
    manifest = readers.read_manifest(spark, str(path))
    assert [tuple(r) for r in manifest.orderBy("patch_id").collect()] == [("a", "x"), ("b", None)]
    writers.write_report(manifest.groupBy().count(), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["count"] == 2
    writers.write_manifest(manifest, str(tmp_path / "w"))
    writers.write_patch_store(manifest, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_index_and_catalog(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "p1.npz").write_bytes(b"12345")
    (tmp_path / "img.TIF").write_bytes(b"abc")
    (tmp_path / "notes.txt").write_text("no")
    (tmp_path / "notes.txt").chmod(0)  # not opened
    index = readers.imagery_index(spark, str(tmp_path))
    assert [tuple(r) for r in index.collect()] == [("p1", 5)]
    assert "content" not in index._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    catalog = readers.raster_catalog(spark, str(tmp_path)).collect()
    assert [(r["extension"], r["sha256"]) for r in catalog] == [(".tif", hashlib.sha256(b"abc").hexdigest())]


def test_record_hash_is_canonical_json(spark):
    df = spark.createDataFrame([("x", None, 3)], "b string, a string, c int")
    want = hashlib.sha256(json.dumps({"a": None, "b": "x", "c": 3}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert df.select(pv.record_hash(["b", "a", "c"]).alias("h")).first()["h"] == want


def test_annotation_scan_prunes_columns_and_pushes_filters(spark, tmp_path):
    spark.range(10).select("id", F.lit("train").alias("split"), F.lit("x").alias("wide")).write.parquet(str(tmp_path / "a"))
    plan = an.filter_split(readers.read_annotations(spark, str(tmp_path / "a"), ["id", "split"]), "train")._jdf.queryExecution().toString()
    assert "EqualTo(split,train)" in plan and "wide" not in plan.split("ReadSchema")[-1]


def write_batches(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def test_gather_stream_across_batches(spark, tmp_path):
    schema = "k string, band string, payload string, pos bigint"
    stream = write_batches(spark, tmp_path, [[("p", "A", "a1", 1), ("q", "A", "x", 1)], [("p", "A", "a2", 2), ("p", "B", "b1", 3), ("p", "A", "late", 4)]], schema)
    got = gather.gather(stream, gather.SetRule("k", "band", "payload", "pos", ["A", "B"]))["sets"].collect()
    assert [(r["key"], r["status"], r["completed_at"], r["items"]) for r in got] == [("p", "complete", 3, {"A": "a2", "B": "b1"})]


def test_health_stream_keeps_state_between_batches(spark, tmp_path):
    schema = "service bigint, event_id bigint, ts_ms bigint, ok int"
    stream = write_batches(spark, tmp_path, [[(1, 0, 0, 0), (1, 1, 1, 0)], [(1, 2, 2, 0), (1, 3, 5000, 1)], [(1, 4, 10_002, 1)]], schema)
    got = run_to_parquet(health.health_stream(stream), "t").orderBy("event_id").collect()
    assert [r["decision"] for r in got] == ["executed"] * 3 + ["rejected", "executed"]
    assert got[-1]["transition"] == "OPEN>HALF_OPEN>CLOSED"


def test_sections_to_nearest_later_marker(spark):
    parts = text.modality_sections(F.col("t"))
    df = spark.createDataFrame([("SAR evidence: dark Optical Evidence: green",), ("plain",)], "t string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in parts.items()]).collect()]
    assert got == [("green", "dark", "", ""), ("", "", "plain", "")]


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    """Two starts on one folder: sets begun before the stop are completed, nothing is doubled or lost."""
    schema, source, folder = "k string, band string, payload string, pos bigint", tmp_path / "in", str(tmp_path / "out")

    def arrive(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"b{n}"))

    def start():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        sets = gather.gather(stream, gather.SetRule("k", "band", "payload", "pos", ["A", "B"]), folder=folder)["sets"]
        return sorted((r["key"], r["items"]["A"], r["items"]["B"]) for r in sets.collect())

    arrive(0, [("p", "A", "a1", 1), ("q", "A", "x", 2), ("q", "B", "y", 3)])
    assert start() == [("q", "x", "y")]
    arrive(1, [("p", "B", "b1", 4), ("q", "B", "late", 5)])
    assert start() == [("p", "a1", "b1"), ("q", "x", "y")]
    assert start() == [("p", "a1", "b1"), ("q", "x", "y")]


def test_batches_of_an_empty_source_give_empty_tables(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema("k int").parquet(str(tmp_path / "none"))
    out = run_batches(stream, "t", lambda b: {"even": b.filter("k % 2 = 0"), "odd": b.filter("k % 2 = 1")})
    assert {n: (df.columns, df.count()) for n, df in out.items()} == {"even": (["k"], 0), "odd": (["k"], 0)}


def test_a_set_whose_size_the_rows_tell(spark, tmp_path):
    schema = "k string, band string, payload string, pos bigint, n int"
    stream = write_batches(spark, tmp_path, [[("p", "A", "a", 1, 1), ("q", "A", "x", 2, 2)], [("q", "C", "y", 3, 2)]], schema)
    got = gather.gather(stream, gather.SetRule("k", "band", "payload", "pos", "n"))["sets"].collect()
    assert sorted((r["key"], r["items"]) for r in got) == [("p", {"A": "a"}), ("q", {"A": "x", "C": "y"})]


def sequential_gather(batches, wanted, reemit):
    """Item by item: (key, completed_at, items) of every set, and what is still held."""
    held, done, out = {}, set(), []
    for batch in batches:
        for k, item, payload, pos in sorted(batch, key=lambda r: r[3]):
            if k in done:
                continue
            held.setdefault(k, {})[item] = payload
            if len(held[k]) == wanted:
                out.append((k, pos, tuple(sorted(held.pop(k).items()))))
                if not reemit:
                    done.add(k)
    return sorted(out), {k: v for k, v in held.items() if v}


@pytest.mark.parametrize("reemit", [False, True])
def test_gather_equals_item_by_item(spark, tmp_path, reemit):
    """Sets within a batch, across batches, repeated items, a key with a third of all rows."""
    rng, schema = random.Random(7), "k string, band string, payload string, pos bigint"
    batches = []
    for b in range(4):
        n = 60
        keys = ["hot" if rng.random() < 0.33 else f"k{rng.randrange(25)}" for _ in range(n)]
        batches.append([(k, rng.choice("ABC"), f"{b}-{i}", i) for i, k in enumerate(keys)])
    stream = write_batches(spark, tmp_path / "in", batches, schema)
    folder = str(tmp_path / "out")
    got = gather.gather(stream, gather.SetRule("k", "band", "payload", "pos", ["A", "B", "C"], reemit), folder=folder)["sets"].collect()
    sets, held = sequential_gather(batches, 3, reemit)
    assert sorted((r["key"], r["completed_at"], tuple(sorted(r["items"].items()))) for r in got) == sets
    left = spark.read.parquet(f"{folder}/state/batch=3/held").groupBy("key").agg(F.collect_set("item").alias("i")).collect()
    assert {r["key"]: set(r["i"]) for r in left} == {k: set(v) for k, v in held.items()}


def test_state_of_a_gather_is_bounded(spark, tmp_path):
    """Keys that stay incomplete are told and forgotten after their time, and so are the marks of whole sets."""
    schema = "k string, band string, payload string, pos bigint"
    batches = [[(f"{b}-{i}", band, "x", i) for i in range(20) for band in ("A", "B")[: 1 + i % 2]] for b in range(6)]
    stream = write_batches(spark, tmp_path / "in", batches, schema)
    ticks, folder = iter(range(100)), str(tmp_path / "out")
    rule = gather.SetRule("k", "band", "payload", "pos", ["A", "B"], ttl_ms=2000)
    sets = gather.gather(stream, rule, folder=folder, clock=lambda: next(ticks))["sets"]
    assert {r["status"]: r["count"] for r in sets.groupBy("status").count().collect()} == {"complete": 60, "incomplete": 40}
    state = [spark.read.parquet(f"{folder}/state/batch=5/{n}").count() for n in ("held", "done")]
    assert state == [20, 20] and not (tmp_path / "out/state/batch=3").exists()


@pytest.mark.parametrize("parts", [0, 3])
def test_table_stream_reads_one_file_and_folders_of_files(spark, tmp_path, parts):
    rows = spark.range(90).withColumnRenamed("id", "event_id")
    rows.repartition(parts or 1).write.parquet(str(tmp_path / "made"))
    if parts:
        (tmp_path / "made").rename(tmp_path / "events.parquet")
    else:
        next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "events.parquet")
    spark.range(5).write.parquet(str(tmp_path / "orders.parquet"))  # another table beside it is not read
    got = run_to_parquet(table_stream(spark, str(tmp_path), "events"), "events")
    assert sorted(r.event_id for r in got.collect()) == list(range(90))
