import hashlib
import random
import zlib

import pytest
from fixtures import SF

from eoframe.llm import trie
from eoframe.llm.queries import QUERIES, SQL
from eoframe.llm.tables import table

EMPTY = hashlib.sha256(b"").hexdigest()


def plain(rows):
    """conv_id, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends of every node, from dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids, ends = {n: [] for n in nodes}, {}
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)
    for c, turns in full.items():
        ends.setdefault(turns, []).append(c)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(nodes[n]) - 1) * len(n[-1][1]) if n else 0)
    return sorted((
        min(nodes[n]), len(n), min(nodes[n[:-1]]) if n else None, len(nodes[n]), len(kids[n]), leaves[n], saved[n],
        hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest(),
    ) for n in nodes)


def run(spark, rows, **sizes):
    data = [(*r, "x", 1) for r in rows]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, path string, shard int")
    found = trie.prefix_trie(df, **sizes)
    assert found.columns == trie.RESULT
    return sorted(map(tuple, found.collect()))


def talk(rng, convs, texts, longest):
    rows = []
    for c in convs:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for t in range(rng.randint(1, longest))]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"window": 3, "shard": 5}, {"window": 1, "shard": 40}, {"window": 4, "shard": 1}])
def test_equals_plain(spark, sizes):
    rng = random.Random(5)
    rows = talk(rng, [*range(30), *range(95, 130), 700, 805, -3, -100, -101], ["a", "bb", "é😀", ""], 7)
    rows += [(c, t, "user", "same") for c in range(200, 240) for t in range(4)]  # a conversation that many share
    rows += [(c, t, "user", "long" if t < 17 else str(c)) for c in (300, 301, 302) for t in range(19)]
    rng.shuffle(rows)
    assert run(spark, rows, **sizes) == plain(rows)


def test_edges(spark):
    """Null and repeated turns, null role, text and id, a conversation whose turns all go, equal rows."""
    rows = [(1, None, "user", "n"), (1, 0, None, None), (1, 0, None, None), (1, 1, "u", "x"), (1, 1, "a", "y"), (None, 0, "u", "x"),
            (2, 5, "user", ""), (3, 0, "user", "q" * 50000), (4, 0, "us", "er"), (5, 0, "u", "ser"), (100, 0, "s", "b"), (100, 1, "s", "c")]
    rows += [(c, 0, "u", "only") for c in range(101, 130)]  # some of these have fewer turns than they lose
    assert any(r[1] == 0 and r[7] != EMPTY for r in plain([r for r in rows if r[0] != 100]))
    for some in (rows, [r for r in rows if r[0] != 100], rows[:1]):
        assert run(spark, some) == plain(some)
        assert run(spark, some, window=1, shard=3) == plain(some)


def test_empty_table_and_turnless(spark):
    assert run(spark, []) == []
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 1)
    assert run(spark, [(c, 0, "u", "x")]) == plain([(c, 0, "u", "x")])


def test_id_lists_across_ranges(spark):
    rows = [(g, 7 * g, c) for g in range(5) for c in range(0, 3000 if g == 2 else 3, 1)]
    ends = spark.createDataFrame(rows, "a long, b long, conv_id long")
    got = {r.a: r.ends_sha256 for r in trie.id_list_digests(ends, ["a", "b"], piece=100).collect()}
    want = {g: hashlib.sha256(",".join(str(r[2]) for r in rows if r[0] == g).encode()).hexdigest() for g in range(5)}
    assert got == want


def test_query_equals_plain_and_sql(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_prefix_trie"](spark, SF).select(*trie.RESULT).collect())) == plain(rows)
    assert "op12_prefix_trie" in SQL
