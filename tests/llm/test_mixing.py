import hashlib
import math
import re
from collections import defaultdict

import pytest
from fixtures import CLASHES, EDGE, SF, docs

from eoframe.llm import mixing
from eoframe.llm.tables import table


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    left = mixing.SHARE * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > mixing.MOST * sizes[s]]
        for s in over or free:
            target[s] = mixing.MOST * sizes[s] if over else left * weight[s] / total
        if not over:
            break
        left -= sum(target[s] for s in over)
        free -= set(over)
    return target


def plain(rows):
    """(doc_id, size, source_size, target, taken), each source ranked whole."""
    sized = [(i, len(re.findall(mixing.WORD, t or "")), s, t or "") for i, t, s in rows]
    sizes = defaultdict(int)
    for _, n, s, _ in sized:
        sizes[s] += n
    target, out = plain_targets(sizes), []
    for s in sizes:
        keyed = []
        for i, n, own, t in sized:
            if own == s:
                u = (int(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                junk = sum(c in mixing.SYMBOLS for c in t)
                keyed.append((-math.log(u) / max(0.1, 1 - 4 * junk / max(1, len(t))), i, n))
        epochs = math.floor(target[s] / sizes[s]) if sizes[s] else 0
        missing, ahead = target[s] - epochs * sizes[s], 0
        for _, i, n in sorted(keyed, key=lambda k: (k[0], k[1] is not None, k[1] or 0, k[2])):
            extra = n if ahead < missing and ahead + n - missing <= missing - ahead else 0
            out.append((i, n, sizes[s], round(target[s], 6), epochs * n + extra))
            ahead += n
    return sorted(out, key=str)


@pytest.mark.parametrize("intervals", [1, 7, 1024])
def test_equals_plain_version(spark, intervals):
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, SF, "documents").collect()] + EDGE
    found = mixing.mix(mixing.sized_documents(docs(spark, rows)), intervals).collect()
    got = sorted([(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in found], key=str)
    assert got == plain(rows)


def test_targets_are_met(spark):
    frame = table(spark, SF.replace("0.001", "0.01"), "documents")
    found = mixing.mix(mixing.sized_documents(frame)).collect()
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in found:
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
        assert 0 <= r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in found)) < 1e-3


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 0, "b": 5}, {"a": 100, "b": 1, "c": 50, None: 7}, {"a": 0}])
def test_levels(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    want = plain_targets(sizes)
    assert found.keys() == want.keys() and all(abs(found[s] - want[s]) < 1e-9 for s in want)


def test_copies_in_the_mix(spark):
    rows = [r for r in EDGE if r[0] is not None and r[0] != 8]
    frame = docs(spark, rows, CLASHES)
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    times = defaultdict(int)
    for r in mixed.collect():
        times[r.doc_id] += 1
    assert times == {i: taken // n for i, n, _, _, taken in plain(rows) if taken}
    assert mixing.mixed_documents(docs(spark, [])).count() == 0


def test_null_and_repeated_ids_in_the_mix(spark):
    rows = [*EDGE, (1, "another text of the first id", "s0"), (None, "one more without an id", "s1"), (8, "one", "s3")]
    mixed = mixing.mixed_documents(docs(spark, rows, CLASHES))
    want = defaultdict(int)
    for i, n, _, _, taken in plain(rows):
        want[i, n] += taken // n if taken else 0
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id, len(re.findall(mixing.WORD, r.text or ""))] += 1
    assert got == {k: n for k, n in want.items() if n}
