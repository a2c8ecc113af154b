import re

import numpy as np
import pytest
import xxhash
from fixtures import CLASHES, EDGE, SF, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from eoframe.llm import simhash
from eoframe.llm.components import connected
from eoframe.llm.tables import table


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, most=2):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("source", ["given", "edge"])
def test_equals_plain_version(spark, source):
    rows = EDGE if source == "edge" else [(r.doc_id, r.text, r.source) for r in table(spark, SF, "documents").collect()]
    found = simhash.near_duplicates(docs(spark, rows, CLASHES)).collect()
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    groups = plain_components(fps)
    least = {}
    for (i, _, _), g in zip(rows, groups):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted([(i, f, least.get(g)) for (i, _, _), f, g in zip(rows, fps, groups)], key=str)
    assert sorted([(r.doc_id, r.fp0 % 2**64, r.component_id) for r in found], key=str) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2, unique=True))
def test_two_that_differ_in_two_bits_meet(x, flips):
    y = x
    for f in flips:
        y ^= 1 << f
    keys, rows = simhash.anchor_rows(np.array([[x], [y]], dtype=np.uint64).view(np.int64), 1, 5)
    assert set(keys[rows == 0]) & set(keys[rows == 1])


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**128 - 1), st.sets(st.integers(0, 127), max_size=15))
def test_fifteen_bits_of_two_words_meet(x, flips):
    y = x
    for f in flips:
        y ^= 1 << f
    fps = np.array([[v & (2**64 - 1), v >> 64] for v in (x, y)], dtype=np.uint64).view(np.int64)
    keys, rows = simhash.anchor_rows(fps, 2, 4)
    assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_every_piece_is_within_one_flip_of_its_first_anchor():
    pieces = np.random.default_rng(1).integers(0, 2**32, 2000)
    rows, anchors = simhash.near_anchors(pieces, 5)
    distance = np.bitwise_count(pieces[rows] ^ anchors)
    assert (distance[: len(pieces)] <= 1).all() and (distance <= 2).all()
    assert len(set(zip(rows.tolist(), anchors.tolist()))) == len(rows)


def test_large_group_of_one_anchor():
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(0, 2**63, 30)]
    fps = np.unique(np.array([f ^ (1 << int(a)) for f in fps for a in rng.integers(0, 60, 60)], dtype=np.uint64))
    assert len(fps) > simhash.COMPARED_WHOLE
    links = simhash.group_links(fps.view(np.int64)[:, None], 2)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(fps))] == plain_components([int(f) for f in fps])
    assert len(links) < len(fps)


def test_components_of_a_path_a_star_and_a_pair(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(-7, 500), (3, 3)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {-7: -7, 500: -7}
    assert found == want
    assert {r.node: r.root for r in connected(spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "a long, b long")).collect()} == {1: 1, 2: 1, 3: 1}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
