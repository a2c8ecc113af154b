import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eoframe.llm import threshold as ta


def plain(rows, k, every):
    """query_id, rank, score and the multiset of ids, by Python's whole numbers."""
    ok = [(n, i, [math.floor(1024 * float(x)) for x in v]) for n, (i, v) in enumerate(rows)
          if v is not None and all(x is not None and math.isfinite(float(x) * 1024) for x in v)]
    out = []
    for n, q, a in ok:
        if q is None or q % every:
            continue
        found = []
        for m, c, b in ok:
            if m != n and len(b) == len(a):
                s = min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)
                found.append((-s, c is None, c or 0))
        out += [(q, r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def run(spark, rows, k=10, every=5, kind="float"):
    data = [(i, v, "x", "y") for i, v in rows]
    df = spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>, row string, block string")
    return sorted(map(tuple, ta.top_products(df, F.col("vec_id") % every == 0, k).collect()), key=repr)


@pytest.mark.parametrize("cells", [1 << 20, 300])
def test_equals_plain_search(spark, monkeypatch, cells):
    monkeypatch.setattr(ta, "BLOCK_CELLS", cells)
    monkeypatch.setattr(ta, "TILE_CELLS", cells // 2)
    monkeypatch.setattr(ta, "FIRST_DEPTH", 2)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(180, 9)).astype(np.float32)
    v[60:120] = v[5]  # a vector that a third of the rows share: ties by id
    v[:, 3] = 0
    v[20:30, 4] = np.round(v[20:30, 4])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    assert run(spark, rows) == plain(rows, 10, 5)


def test_block_search_stops_early_and_keeps_ties():
    rng = np.random.default_rng(2)
    vectors = np.round(rng.normal(size=(4000, 6)) ** 3 * 100)
    lists = ta.sorted_lists(vectors)
    for t in range(60):
        query = np.round(rng.normal(size=6) * 50) * (rng.random(6) < 0.7)
        own = int(rng.integers(4000)) if t % 2 else None
        scores = vectors @ query
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != own)[:7]
        at, got = ta.best_in_block(vectors, lists, query, 7, own, None, 1e6)
        assert list(zip((-s for s in got), at)) == want
        floor = int(-want[3][0])
        at, got = ta.best_in_block(vectors, lists, query, 7, own, floor, 1e6)
        assert list(zip((-s for s in got), at)) == [w for w in want if -w[0] >= floor]


def test_reads_few_rows(monkeypatch):
    """On lists with a long tail only a part of the block is scored."""
    rng = np.random.default_rng(3)
    vectors, scored = np.floor(np.exp(2.5 * rng.normal(size=(20000, 3)))), []
    whole = ta.products
    monkeypatch.setattr(ta, "products", lambda v, q, e: scored.append(len(v)) or whole(v, q, e))
    ta.best_in_block(vectors, ta.sorted_lists(vectors), np.array([3.0, 1.0, 2.0]), 10, None, None, vectors.max())
    assert sum(scored) < 4000


def test_rows_that_take_no_part_and_repeat(spark):
    one = [0.5, -0.25]
    rows = [(0, one), (0, one), (5, [0.1, 0.1]), (5, [0.2, 0.3]), (None, [9.0, 9.0]), (None, one), (1, None), (2, [None, 1.0]),
            (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (10, []), (15, []), (6, [1.0, 2.0, 3.0]), (20, [0.0, 0.0]), (7, one)]
    assert run(spark, rows) == plain(rows, 10, 5)
    assert run(spark, rows, k=2) == plain(rows, 2, 5)


def test_very_large_components(spark):
    rows = [(0, [1e200, 1e-200]), (5, [3e12, -2e12]), (6, [3e12, -2e12]), (7, [1e300, 0.0]), (8, [-1e300, 5.0]), (10, [1e306, 1.0]),
            (11, [2.0, 1.0]), (15, [1.5, 2.5])]
    assert run(spark, rows, kind="double") == plain(rows, 10, 5)


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == []  # no query
