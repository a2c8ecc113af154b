import zlib
from collections import defaultdict

import numpy as np
from fixtures import CLASHES, EDGE, SF, docs

from eoframe.llm import sharding
from eoframe.llm.tables import table


def shards_of(spark, frame, n=8):
    return sharding.assign_shards(sharding.sized_rows(frame), n).collect()


def check(found, rows, n):
    assert len(found) == len(rows)
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in found), key=str) == want
    slots = defaultdict(list)
    for r in found:
        assert 0 <= r.shard < n
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_edges(spark):
    check(shards_of(spark, docs(spark, EDGE, CLASHES)), EDGE, 8)
    assert shards_of(spark, docs(spark, [])) == []


def test_sizes_are_near_equal_and_copies_stay_together(spark):
    frame = table(spark, SF.replace("0.001", "0.01"), "documents")
    rows = [(r.doc_id, r.text, r.source) for r in frame.collect()]
    found = shards_of(spark, frame)
    check(found, rows, 8)
    loads = np.zeros(8)
    for r in found:
        loads[r.shard] += r["size"]
    assert loads.max() / loads.mean() < 1.02 and loads.min() / loads.mean() > 0.98


def test_a_hot_key_is_split_and_reruns_agree(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text number {i}", "s") for i in range(900)]
    first, again = shards_of(spark, docs(spark, rows)), shards_of(spark, docs(spark, rows[::-1]))
    check(first, rows, 8)
    assert {(r.doc_id, r.shard, r.slot) for r in first} == {(r.doc_id, r.shard, r.slot) for r in again}
    loads = np.zeros(8)
    for r in first:
        loads[r.shard] += r["size"]
    assert loads.max() / loads.mean() < 1.02


def test_limited_movement(spark):
    rows = [(i, f"text number {i} " * (i % 5 + 1), "s") for i in range(4000)]
    a = {r.doc_id: r.shard for r in shards_of(spark, docs(spark, rows), 8)}
    b = {r.doc_id: r.shard for r in shards_of(spark, docs(spark, rows), 9)}
    assert np.mean([a[i] != b[i] for i in a]) < 0.5  # a plain modulus moves 8 of 9


def test_pieces_cover_the_ring_within_the_bound():
    rng = np.random.default_rng(3)
    points, owners = sharding.ring(5, 8)
    assert (np.diff(points) > 0).all()
    arcs = rng.integers(0, 100, len(owners) + 1).tolist()
    arcs[7] = 5000
    full = -(-sum(arcs) * 1001 // 5000)
    pieces = sharding.arcs_to_shards(arcs, owners, 5, full)
    assert pieces[0][0] == 0 and pieces[-1][1] == sum(arcs)
    assert all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    loads = np.zeros(5)
    for s, e, k in pieces:
        loads[k] += e - s
    assert loads.max() <= full


def test_repeated_rows_lie_in_many_ranges(spark, monkeypatch):
    from eoframe.llm import tables

    most, write = [], tables.materialize

    def seen(df, purpose):
        out = write(df, purpose)
        if purpose == "ranges":
            most.append(out.groupBy("_range").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(tables, "materialize", seen)
    rows = [(None, "one and the same text", "s")] * 1500 + [(i, f"text {i}", "s") for i in range(1500)]
    found = shards_of(spark, docs(spark, rows))
    assert len(found) == 3000 and max(most) < 900
    for shard in range(8):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
