import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from fixtures import CLASHES, EDGE, SF, docs

from eoframe.llm import periods
from eoframe.llm.queries import QUERIES
from eoframe.llm.tables import documents


def plain_runs(words):
    """start, period, length of every run, word by word."""
    n, least = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p):
                least.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, p, length) for (s, length), p in least.items())


def plain_row(doc_id, text, plant=True):
    words = (text or "").encode().split()
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, p, length in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
    four = (None,) * 4 if best is None else (best[0], best[2], best[1], 1000 * best[2] // best[1])
    listed = "".join(f"{s},{length},{p}\n" for s, p, length in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def by_text(rows):
    return sorted(rows, key=repr)


def test_cover_holds_every_difference():
    for d in range(periods.MODULUS):
        assert any((a - b) % periods.MODULUS == d for a in periods.COVER for b in periods.COVER)
    s = periods.shifts()
    assert s.min() >= 0 and (np.diag(s) < periods.MODULUS).all()


def test_extensions_equal_plain():
    rng = np.random.default_rng(3)
    for n, k in ((5, 2), (200, 1), (500, 2), (900, 40)):
        ids = rng.integers(1, k + 1, n)
        ids[n // 2 :] = ids[: n - n // 2]
        e = periods.Extensions(ids)
        i = rng.integers(0, n - 1, 400)
        j = np.minimum(i + rng.integers(1, n, 400), n)
        want = [next((t for t in range(n) if b + t >= n or ids[a + t] != ids[b + t]), n) for a, b in zip(i, j)]
        assert e.alike(i, j).tolist() == want


def test_runs_equal_plain(monkeypatch):
    rng = random.Random(1)
    for t in range(400):
        monkeypatch.setattr(periods, "ASKED", 50 if t % 2 else 1 << 20)
        n = rng.choice([0, 1, 23, 24, 25, 72, 150, 400])
        words = [rng.randint(1, rng.choice([1, 2, 3, 60])) for _ in range(n)]
        for _ in range(rng.randint(0, 4) if n > 10 else 0):
            a, p = rng.randrange(n), rng.randint(1, n // 4)
            for x in range(a + p, rng.randint(a, n)):
                words[x] = words[x - p]
        s, length, p = (x.tolist() for x in periods.find_runs(np.array(words, dtype=np.int64)))
        assert list(zip(s, p, length)) == plain_runs(words)


def test_strongest_is_exact():
    big = 3 * 10**15
    assert periods.strongest([0, 9, 20], [big, big + 1, big + 1], [10**15, 10**15, 10**15]) == 1


def test_edges(spark):
    """Nulls, empty, repeated and long texts, ties of two runs, white space that is none, clashing columns."""
    tie = "a b c " * 9 + "| " + "d e f " * 9
    rows = [*EDGE, (20, tie, "s"), (20, tie, "s"), (30, "x y z " * 30, "s"), (None, "q " * 40, None), (31, "w " * 23, "s"),
            (38, " ".join(map(str, range(500))), "s")]
    got = periods.run_digests(periods.periodic_runs(docs(spark, rows, ["starts", "collapsed", "periods", *CLASHES]), plant=True))
    assert by_text(map(tuple, got.collect())) == by_text(plain_row(i, t) for i, t, _ in rows)
    assert any(r[1] for r in (plain_row(i, t) for i, t, _ in rows))


def test_empty_table(spark):
    assert periods.run_digests(periods.periodic_runs(docs(spark, []))).collect() == []


def test_text_that_is_left(spark):
    row = periods.periodic_runs(docs(spark, [(1, "go " + "a b\n" * 20 + "end", "s")])).first()
    assert (row.starts, row.lengths, row.periods, row.strongest) == ([1], [40], [2], 0)
    assert bytes(row.collapsed) == b"go a b end"


def test_query_equals_plain(spark):
    rows = documents(spark, SF).collect()
    want = by_text(plain_row(r.doc_id, r.text) for r in rows if r.text is None or len(r.text) < 20000)
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(rows) and [got[r[0]] for r in want] == [r for r in want]
