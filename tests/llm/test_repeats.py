import random
from collections import Counter

import numpy as np
import pytest
from fixtures import CLASHES, EDGE, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from eoframe.llm import repeats


def plain(rows, length):
    data = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for (i, _, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(d), sum(gone), spans, kept))
    return sorted(out, key=str)


def run(spark, rows, length, gram, extra=None):
    found = repeats.remove_repeats(docs(spark, rows, extra), length, gram).collect()
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found], key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_version(spark, monkeypatch, seed):
    monkeypatch.setattr(repeats, "BYTES_AT_ONCE", 64)
    monkeypatch.setattr(repeats, "RUN", 40)
    monkeypatch.setattr(repeats, "MERGED", 100)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 60)))
    shared = [word() for _ in range(6)]
    rows = [(i, "".join(rng.choice([word(), rng.choice(shared)]) for _ in range(rng.randint(0, 8))), "s") for i in range(60)]
    rows += [(100, "abc" * 40, "s"), (101, None, "s"), (102, rows[3][1], "s"), (102, rows[3][1], "s"), (None, rows[5][1], "s")]
    assert run(spark, rows, 20, 6) == plain(rows, 20)


def test_edges(spark):
    assert run(spark, EDGE, 200, 32, CLASHES) == plain(EDGE, 200)
    assert run(spark, [], 200, 32) == []


def test_common_passage_in_many_texts(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 200))) + (passage if i % 3 else "") + str(i), "s")
            for i in range(150)]
    assert run(spark, rows, 100, 20) == plain(rows, 100)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=70), min_size=1, max_size=8), min_size=1, max_size=6))
def test_loser_tree_merges_front_coded_runs(parts):
    runs, everything = [], []
    for n, part in enumerate(parts):
        items: dict = {}
        for k, s in enumerate(part):
            items.setdefault((s.encode(), k % 2), []).append((n, k, k))
        coded = [(s, h, np.array(p, dtype=repeats.PLACE)) for (s, h), p in sorted(items.items())]
        runs.append(repeats.Run(*repeats.Run.encode(coded)))
        everything += [key for key, p in items.items() for _ in p]
    merged = list(repeats.merge_runs(runs))
    keys = [(s, h) for s, h, _, _ in merged]
    assert keys == sorted(set(everything))
    assert Counter(everything) == {(s, h): sum(map(len, p)) for s, h, _, p in merged}
    for (a, *_), (b, _, lcp, _) in zip(merged, merged[1:]):
        assert lcp == repeats.common_prefix(a, b, 0)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=100), st.binary(max_size=100), st.binary(max_size=100))
def test_common_prefix(p, a, b):
    x, y = p + a, p + b
    true = next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
    assert repeats.common_prefix(x, y, 0) == repeats.common_prefix(x, y, len(p)) == true


@settings(max_examples=100, deadline=None)
@given(st.text("ab", min_size=20, max_size=200), st.text("ab", max_size=30), st.text("ab", max_size=30))
def test_equal_strings_have_equal_anchors(s, left, right):
    found = []
    for before, after in ((left, right), (right, left)):
        data = np.frombuffer((before + s + after).encode(), np.uint8)
        places, grams, first, last = repeats.anchors(data, 20, 6)
        own = {}
        for p, g, a, b in zip(places, grams, first, last):
            for start in range(a, b + 1):
                own[start - len(before)] = (p - start, g)
        found.append([own[k] for k in range(len(s) - 19)])
    assert found[0] == found[1]
