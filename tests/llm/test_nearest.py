import numpy as np
import pytest
from pyspark.sql import functions as F

from eoframe.llm import nearest as nn


def plain(rows, k, every):
    ok = [(n, i, np.array(v, dtype=float)) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
          and any(v)]
    out = []
    for n, q, v in ok:
        if q % every:
            continue
        found = []
        for m, c, w in ok:
            if m != n and len(w) == len(v):
                a, b = (x / 2.0 ** np.frexp(np.abs(x).max())[1] for x in (v, w))
                dot = lambda a, b: np.cumsum(a * b)[-1]
                found.append((-(dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))), c))
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


def run(spark, rows, k=5, every=3, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return sorted(map(tuple, nn.nearest(df, F.col("vec_id") % every == 0, k).collect()))


@pytest.mark.parametrize("tiles", [(4096, 16384), (16, 32)])
def test_equals_plain_search(spark, monkeypatch, tiles):
    monkeypatch.setattr(nn, "QUERY_TILE", tiles[0])
    monkeypatch.setattr(nn, "CANDIDATE_TILE", tiles[1])
    monkeypatch.setattr(nn, "QUERY_BLOCK", 8)
    monkeypatch.setattr(nn, "CANDIDATE_BLOCK", 24)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(150, 12)).astype(np.float32)
    v[60:110] = v[5]  # one very common vector, ties by id
    v[110:120] = v[5] * np.float32(2)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    assert run(spark, rows) == plain([r[:2] for r in rows], 5, 3)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0], 0), (3, [0.0, 0.0], 0), (6, None, 0), (9, [], 0), (1, [float("nan"), 1.0], 0), (2, [None, 1.0], 0),
            (4, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0), (5, [1.0, 1.0], None), (7, [1.0, 2.0, 3.0], 0), (12, [2.0, 0.0], 0)]
    assert run(spark, rows) == plain([r[:2] for r in rows], 5, 3)


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 0)]) == []


def test_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(20, 33)), rng.normal(size=(30, 33)) * 1e6
    (qa, sa, ea), (qb, sb, eb) = nn.quantise(a), nn.quantise(b)
    near = nn.product_tile(qa, qb) * sa[:, None] * sb[None]
    true = (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    error = ea[:, None] * (1 + eb) + eb[None] * (1 + ea[:, None]) + ea[:, None] * eb
    assert qa.dtype == np.int8 and (np.abs(near - true) <= error + 1e-9).all()


def test_rows_that_repeat_an_id(spark):
    """Two queries of one id, one vector or two, are two results; each is a candidate of the other."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist(), 0) for i in (0, 0, 3, 3, 1, 2, 2, 4)] + [(3, [1.0, 2.0, 3.0, 4.0], 0)] * 2
    assert run(spark, rows) == plain([(i, np.float32(v).tolist()) for i, v, _ in rows], 5, 3)


def test_components_of_any_size(spark):
    rows = [(0, [1e200, 1e200], 0), (1, [1e-200, 0.0], 0), (2, [1e300, -1e300], 0), (3, [5e-324, 5e-324], 0), (4, [1.0, 2.0], 0)]
    got = run(spark, rows, kind="double")
    assert got == plain([r[:2] for r in rows], 5, 3) and all(s is not None and np.isfinite(s) for *_, s in got)
    assert got[0] == (0, 1, 3, 1.0)
