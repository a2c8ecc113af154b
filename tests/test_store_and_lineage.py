"""The versioned store under failures, lineage against a plain search, contracts compiled from schemas."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from eoframe import session
from eoframe.operators import contracts
from eoframe.operators import lineage as ln
from eoframe.session import clean_up, materialize, shared_dir
from eoframe.sources import writers
from eoframe.sources.store import Conflict, VersionedStore

ROW = "patch_id string, s2 string, s1 string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), ROW)


def held(df):
    return sorted(map(tuple, df.select("patch_id", "s2", "s1").collect()))


def test_versions_are_immutable_and_pinned(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"), buckets=16)
    assert store.versions() == []
    first = [(f"p{i}", "a", None) for i in range(40)]
    assert store.upsert(rows(spark, *first)) == 0
    pinned = store.read()
    assert store.upsert(rows(spark, ("p1", "b", "x"), ("new", "c", None), (None, "no", "key"), ("p2", "d", None), ("p2", "d", None))) == 1
    want = {r[0]: r for r in first} | {"p1": ("p1", "b", "x"), "new": ("new", "c", None), "p2": ("p2", "d", None)}
    assert held(pinned) == sorted(first) and held(store.read()) == sorted(want.values()) and held(store.read(0)) == sorted(first)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"), buckets=32)
    store.upsert(rows(spark, *[(f"p{i}", "a", None) for i in range(300)]))
    store.upsert(rows(spark, ("p7", "z", None)))
    before, after = store.commit_of(0)["folders"], store.commit_of(1)["folders"]
    changed = [b for b in after if after[b] != before.get(b)]
    assert len(before) == 32 and len(changed) == 1
    bucket = spark.range(1).select(store.bucket(F.lit("p7"))).first()[0]
    assert changed == [str(bucket)] and store.read(1, [bucket]).where("s2 = 'z'").count() == 1
    assert VersionedStore(spark, str(tmp_path / "s"), buckets=5).upsert(rows(spark, ("p8", "y", None))) == 2  # keeps its 32 buckets
    assert store.read().count() == 300


def test_a_writer_that_dies_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    store = VersionedStore(spark, str(tmp_path / "s"), buckets=4)
    store.upsert(rows(spark, ("p", "a", None)))
    with monkeypatch.context() as m:
        m.setattr(VersionedStore, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.upsert(rows(spark, ("p", "b", None)))
    assert store.versions() == [0] and held(store.read()) == [("p", "a", None)]
    assert store.upsert(rows(spark, ("p", "c", None))) == 1 and held(store.read()) == [("p", "c", None)]
    assert store.vacuum(keep=1) == 2 and held(store.read()) == [("p", "c", None)] and store.versions() == [1]


def test_of_two_writers_one_is_told(spark, tmp_path, monkeypatch):
    store = VersionedStore(spark, str(tmp_path / "s"), buckets=4)
    store.upsert(rows(spark, ("p", "a", None)))
    commit = VersionedStore.commit

    def late(self, number, content):
        monkeypatch.setattr(VersionedStore, "commit", commit)
        self.upsert(rows(spark, ("q", "b", None)))  # another writer is quicker
        commit(self, number, content)

    monkeypatch.setattr(VersionedStore, "commit", late)
    with pytest.raises(Conflict):
        store.upsert(rows(spark, ("p", "c", None)))
    assert held(store.read()) == [("p", "a", None), ("q", "b", None)]


def test_merge_keeps_what_either_side_has(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"), buckets=4)
    store.upsert(rows(spark, ("p", "a", None), ("q", "b", None)))
    store.upsert(rows(spark, ("p", None, "x"), ("r", None, "y")), merge={})
    assert held(store.read()) == [("p", "a", "x"), ("q", "b", None), ("r", None, "y")]


def plain_closure(links):
    out = {}
    for start in {a for a, _ in links}:
        near, d = {start}, 0
        while near:
            d += 1
            near = {p for a, p in links if a in near} - {x for (s, x) in out if s == start}
            out |= {(start, p): d for p in near}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_closure_equals_plain_search(spark, seed):
    rng = random.Random(seed)
    links = {(f"r{i}", f"r{rng.randrange(max(i, 1))}") for i in range(1, 60)}
    links |= {(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)} | {("c0", "r5"), ("lone", "gone")}  # a cycle, an unknown parent
    links |= {(f"h{i}", "hot") for i in range(30)} | {("hot", "r40")}
    records = spark.createDataFrame(
        [(a, [p for b, p in links if b == a] + ["", None]) for a in sorted({a for a, _ in links} | {"r0"})],
        "output_id string, lineage_parent_ids array<string>",
    )
    closure = ln.lineage_closure(ln.parent_links(records))
    want = plain_closure(links)
    assert {(r.id, r.ancestor): r.distance for r in closure.collect()} == want
    got = {r.id: r for r in ln.lineage_summary(records, closure).collect()}
    assert {i for i, r in got.items() if r.in_cycle} == {f"c{i}" for i in range(9)}
    assert got["r0"].n_ancestors == 0 and got["lone"].n_unknown == got["lone"].n_sources == 1
    assert got["h3"].depth == max(d for (i, _), d in want.items() if i == "h3")


def test_closure_of_nothing_and_of_a_long_chain(spark):
    none = spark.createDataFrame([], "id string, parent string")
    assert ln.lineage_closure(none).count() == 0
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(40)], "id string, parent string")
    assert ln.lineage_closure(chain).agg(F.max("distance"), F.count(F.lit(1))).first()[:] == (40, 820)


def violations(spark, schema, definitions, *payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload string")
    return [r.violations for r in contracts.check_schema(df, schema, definitions).orderBy("i").collect()]


def test_compiler_on_another_schema(spark):
    definitions = {"Leaf": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 0}}}}
    schema = {
        "type": "object", "required": ["kind"],
        "properties": {
            "kind": {"type": "string", "enum": ["a", "b"]},
            "grid": {"type": "array", "items": {"type": "array", "items": {"$ref": "#/definitions/Leaf"}}},
        },
    }
    got = violations(
        spark, schema, definitions, '{"kind": "a", "other": 1}', '{"kind": "c"}', '{"kind": "b", "grid": [[{"n": 1}], [{"n": -1}, {}, 5]]}',
        '{"kind": "b", "grid": [[{"n": 1.5}], 3]}', None, "{", json.dumps("a"),
    )
    assert got == [
        [], ["kind: not one of the values"], ["grid[1][0].n: below 0", "grid[1][1].n: missing", "grid[1][2]: not object"],
        ["grid[0][0].n: not integer", "grid[1]: not array"], ["unreadable"], ["unreadable"], ["payload: not object"],
    ]


def test_files_are_written_by_tasks(spark, tmp_path):
    df = spark.createDataFrame([("a.bin", b"123"), ("b.bin", b""), ("c.bin", None)], "name string, content binary")
    told = writers.write_files(df, str(tmp_path / "f")).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.size_bytes) for r in told) == [("a.bin", 3), ("b.bin", 0)]
    assert (tmp_path / "f/a.bin").read_bytes() == b"123" and not (tmp_path / "f/c.bin").exists()


class Settings:
    """A session of which only the settings matter."""

    def __init__(self, **held):
        self.conf = self
        self.held = held

    def get(self, name, default=None):
        return self.held.get(name, default)


def test_shared_folder_comes_from_the_session(monkeypatch):
    monkeypatch.setattr(session, "_GIVEN", [])
    given = shared_dir(Settings(**{"spark.checkpoint.dir": "hdfs://x/cp/", "spark.master": "yarn"}), "t")
    assert given.startswith("hdfs://x/cp/t-")
    one, two = (shared_dir(Settings(**{"spark.master": "local[2]"}), "t") for _ in range(2))
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]
    with pytest.raises(ValueError):
        shared_dir(Settings(**{"spark.master": "spark://host:7077"}), "t")


def test_intermediates_can_be_cleaned_up(spark, monkeypatch):
    monkeypatch.setattr(session, "_GIVEN", [])
    kept = materialize(spark.range(5), "t")
    path = kept.inputFiles()[0].rsplit("/", 1)[0]
    assert kept.count() == 5 and clean_up(spark) == 1 and clean_up(spark) == 0
    assert not os.path.exists(path.removeprefix("file://"))


def test_closure_writes_each_pair_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ln, "materialize", lambda df, purpose, put=ln.materialize: (out := put(df, purpose), written.append(out.count()))[0])
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(40)], "id string, parent string")
    assert ln.lineage_closure(chain).count() == sum(written) == 820
