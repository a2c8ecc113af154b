import hashlib

import pytest
from fixtures import CLASHES, EDGE, docs

from eoframe.llm.exact_dedup import DigestIndex, add_batch, keep_distinct


def plain(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    out, seen = [], set()
    for i, t, _ in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        keep = max(known) if known else None
        first = (t or "", i) not in seen
        seen.add((t or "", i))
        out.append((i, keep, len(ids), i == keep and first, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_decisions_equal_plain_version(spark):
    found = add_batch(DigestIndex(spark), docs(spark, EDGE)).collect()
    assert sorted([tuple(r) for r in found], key=str) == plain(EDGE)


def test_hot_group(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i}", "s") for i in range(600)]
    found = add_batch(DigestIndex(spark), docs(spark, rows)).collect()
    assert sorted([tuple(r) for r in found], key=str) == plain(rows)


def test_later_batches_meet_the_index(spark):
    index = DigestIndex(spark, buckets=4)
    add_batch(index, docs(spark, [(1, "a", "s"), (2, "b", "s")])).collect()
    again = {r.doc_id: r for r in add_batch(index, docs(spark, [(3, "a", "s"), (4, "c", "s"), (5, "c", "s")])).collect()}
    assert (again[3].kept, again[3].keep_id) == (False, 1)
    assert (again[4].kept, again[5].kept, again[4].keep_id) == (False, True, 5)
    assert index.table().count() == 3
    reopened = DigestIndex(spark, path=index.path, name=index.name + "_again", buckets=4)
    assert reopened.table().count() == 3


def test_anti_join_reads_the_index_without_moving_it(spark):
    index = DigestIndex(spark, buckets=4)
    add_batch(index, docs(spark, [(i, f"t{i}", "s") for i in range(40)]))
    batch = index.table().select("digest").repartition(4, "digest")
    plan = batch.hint("merge").join(index.table().select("digest"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Bucketed: true" in text


@pytest.mark.parametrize("extra", [None, CLASHES])
def test_kept_rows(spark, extra):
    table = docs(spark, EDGE, extra)
    kept = keep_distinct(table)
    assert kept.columns == table.columns
    assert sorted([(r.text or "") for r in kept.collect()]) == sorted({t or "" for _, t, _ in EDGE})


def test_empty_table(spark):
    assert add_batch(DigestIndex(spark), docs(spark, [])).count() == 0
    assert keep_distinct(docs(spark, [])).count() == 0


def test_a_batch_that_is_run_again_keeps_its_documents(spark):
    """Also when the first run got only some of its texts into the index."""
    index, rows = DigestIndex(spark, buckets=4), docs(spark, [(1, "a", "s"), (2, "b", "s"), (3, "b", "s"), (4, "old", "s")])
    add_batch(index, docs(spark, [(0, "old", "s")]), batch="first")
    want = sorted(map(tuple, add_batch(index, rows, batch="second").collect()))
    assert sum(r[3] for r in want) == 2 and sorted(map(tuple, add_batch(index, rows, batch="second").collect())) == want
    assert index.table().count() == 3 and sum(r.kept for r in add_batch(index, rows, batch="third").collect()) == 0
    torn = DigestIndex(spark, buckets=4)
    add_batch(torn, docs(spark, [(1, "a", "s")]), batch="second")
    add_batch(torn, docs(spark, [(0, "old", "s")]), batch="first")
    assert sorted(map(tuple, add_batch(torn, rows, batch="second").collect())) == want
