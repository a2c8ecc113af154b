import re
from collections import Counter, defaultdict

import numpy as np
from fixtures import CLASHES, EDGE, docs

from eoframe.llm import near_copies
from eoframe.llm.tables import documents

SF = "/root/testdata/sf0.01"


def plain_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(b" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))) if words else frozenset()


def plain_links(sets, least=0.8):
    """Pairs of distinct sets with at least this much in common."""
    having, links = defaultdict(list), []
    sets = list(set(sets))
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in having[x])
        links += [(sets[j], s) for j, n in shared.items() if n >= least * (len(s) + len(sets[j]) - n) - 1e-9]
        for x in s:
            having[x].append(i)
    return links


def plain_kept(rows):
    """(doc_id, text) of the row that stays of every component."""
    sets = [plain_set(t) for _, t in rows]
    parent = {s: s for s in sets}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for a, b in plain_links(sets):
        parent[root(a)] = root(b)
    best = {}
    for (i, t), s in zip(rows, sets):
        own = (i is None, i or 0, t or "")
        best[root(s)] = min(best.get(root(s), own), own)
    return [(None if null else i, t) for null, i, t in best.values()]


def test_given_documents_equal_plain_version(spark):
    given = documents(spark, SF)
    rows = [(r.doc_id, r.text) for r in given.collect()]
    assert plain_links([plain_set(t) for _, t in rows])
    assert sorted(r.doc_id for r in near_copies.keep_one_each(given).collect()) == sorted(i for i, _ in plain_kept(rows))


def test_links_are_pairs_of_four_fifths_exactly(spark):
    """Sets that share 8 of 10 shingles link, 7 of 9 do not; and so do long ones on either side of the bound."""
    def pair(shared, own):  # two texts with `shared` common shingles and `own` further ones each
        return [f"w{k}" for k in range(shared + 4)], [f"a{k}" for k in range(own)], [f"b{k}" for k in range(own)]

    rows = []
    for at, (shared, own) in enumerate([(8, 1), (7, 1), (80, 10), (79, 11), (800, 100), (790, 110)]):
        base, one, two = pair(shared, own)
        tell = lambda words: " ".join(f"{at}x{w}" for w in words)
        rows += [(2 * at, tell(base + one), "s"), (2 * at + 1, tell(base + two), "s")]
    kept = {r.doc_id for r in near_copies.keep_one_each(docs(spark, rows, CLASHES)).collect()}
    assert {3, 7, 11} <= kept and {0, 2, 4, 6, 8, 10} <= kept and not kept & {1, 5, 9}


def test_repeated_line_does_not_make_copies(spark):
    """A line that fills most of two texts counts once."""
    rng = np.random.default_rng(3)
    rows = [(i, "the same line over again . " * 200 + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)), "s") for i in range(30)]
    assert near_copies.keep_one_each(docs(spark, rows)).count() == 30


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    rows, clean = [], []
    for g in range(20):
        base = words(400)
        rows.append((g * 10, " ".join(base), "s"))
        clean.append(g * 10)
        for c in range(1, 4):
            other = list(base)
            for at in rng.integers(0, 400, 3):
                other[at] = "changed"
            rows.append((g * 10 + c, " ".join(other), "s"))
    for i in range(1000, 1100):
        rows.append((i, " ".join(words(400)), "s"))
        clean.append(i)
    frame = docs(spark, rows, CLASHES)
    kept = near_copies.keep_one_each(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(clean)
    assert near_copies.keep_one_each(docs(spark, [])).count() == 0


def test_large_group_of_near_copies(spark):
    """A third of all rows are near copies of one text: no more than a few pairs per row are proposed, and one row stays."""
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 100_000, 300)]
    rows = []
    for i in range(1500):
        other = list(base)
        for at in rng.integers(0, 300, int(rng.integers(1, 5))):
            other[at] = f"c{i}"
        rows.append((i, " ".join(other), "s"))
    rows += [(i, " ".join(f"w{x}" for x in rng.integers(0, 100_000, 60)), "s") for i in range(2000, 5000)]
    frame = docs(spark, rows)
    own = near_copies.signatures(frame).dropDuplicates(["node"])
    assert near_copies.proposed_pairs(own).count() <= (near_copies.FORESTS + 1) * near_copies.BANDS * len(rows) / 2
    # four words of 300 are in at most 20 of 296 shingles: every copy has at least 276 of 316 in common with the original
    assert {r.doc_id for r in near_copies.keep_one_each(frame).collect()} == {0, *range(2000, 5000)}


def test_proposals_grow_with_the_rows(spark):
    """Four times as many unlike texts meet no more than four times as often."""
    rng = np.random.default_rng(7)
    word = [f"w{x}" for x in range(5000)]

    def meetings(n):
        rows = [(i, " ".join(word[x] for x in rng.integers(0, 5000, 80)), "s") for i in range(n)]
        found = near_copies.signatures(docs(spark, rows)).selectExpr("explode(bands) AS key").groupBy("key").count()
        return found.selectExpr("coalesce(sum(count * (count - 1) / 2), 0) AS n").first().n

    assert meetings(500) <= 5 and meetings(2000) <= 20


def test_null_and_repeated_ids_stay_documents(spark):
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in rng.integers(0, 100_000, 400)]
    near = " ".join([*words[:-1], "changed"])
    rows = [*EDGE, (1, "quite another text of the first id", "s0"), (50, " ".join(words), "s0"), (60, near, "s0"),
            (60, "the other text of sixty", "s0"), (None, " ".join(["changed", *words[1:]]), "s0")]
    frame = docs(spark, rows, CLASHES)
    kept = near_copies.keep_one_each(frame)
    assert kept.columns == frame.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert {(i, t or "") for i, t in found} == {(i, t or "") for i, t in plain_kept([(i, t) for i, t, _ in rows])}
    assert (None, "no id here") in found and (60, "the other text of sixty") in found and (60, near) not in found


def test_anchors_of_the_covering_code_propose_near_copies(spark, monkeypatch):
    """Without the bands, texts whose fingerprints differ in two bits or fewer are still found, and still checked exactly."""
    rng = np.random.default_rng(5)
    long = [f"w{x}" for x in rng.integers(0, 10**9, 3000)]
    other = [*long[:1500], "changed", *long[1501:]]
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[::-1])), (4, ""), (5, "a b"), (6, "a b c")]
    nothing = "a long, b long"
    monkeypatch.setattr(near_copies, "proposed_pairs", lambda nodes: spark.createDataFrame([], nothing))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one_each(made).collect()) == [1, 3, 4, 5, 6]


def test_anchored_pairs_connect_all_within_two_bits(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**62), 2**62, 40).tolist()
    prints = base + [b ^ 1 << int(k) ^ 1 << int(j) for b, k, j in zip(base, rng.integers(0, 60, 40), rng.integers(0, 60, 40))] + base[:5]
    nodes = spark.createDataFrame([(i, 1, p) for i, p in enumerate(prints)] + [(999, 0, prints[0])], "node long, n long, fp0 long")
    got = {(r.a, r.b) for r in near_copies.anchored_pairs(nodes).collect()}
    assert all(a < b for a, b in got) and all(bin((prints[a] ^ prints[b]) & (2**64 - 1)).count("1") <= 2 for a, b in got)
    assert {(k, 40 + k) for k in range(40)} <= got and {(k, 80 + k) for k in range(5)} <= got


def near_members(n, seed=1):
    """Fingerprints that differ in 30 to 70 bits, so all pairs are within the bound and none is close to the centre."""
    rng = np.random.default_rng(seed)
    fps = np.zeros((n, 4), dtype=np.uint64)
    for k in range(n):
        for bit in rng.choice(256, 26, replace=False).tolist():
            fps[k, bit // 64] |= np.uint64(1 << bit % 64)
    return fps.view(np.int64), np.full(n, 100)


def test_forests_are_the_same_whatever_the_blocks(monkeypatch):
    fps, sizes = near_members(300)
    want = sorted(near_copies.proposals(fps, sizes))
    for pairs in (1, 5000):
        monkeypatch.setattr(near_copies, "PAIRS_AT_ONCE", pairs)
        assert sorted(near_copies.proposals(fps, sizes)) == want
    assert len(want) == 3 * 299


def test_a_large_band_is_compared_in_bounded_memory():
    import tracemalloc

    fps, sizes = near_members(2000)
    tracemalloc.start()
    found = near_copies.proposals(fps, sizes)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(found) <= 3 * 1999
    assert peak < 150, peak  # all pairs at once: 64 MB as numbers, and 400 MB as lists


def test_near_copies_without_a_common_band_or_anchor_are_found(spark):
    """Of 3000 pairs with four fifths in common (20 of 25 shingles) the bands miss those that are given here."""
    rng, rows = np.random.default_rng(7), []
    for _ in range(3000):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 24)]
        pair = " ".join(words), " ".join(words + [f"w{x}" for x in rng.integers(0, 10**6, 5)])
        one, two = (set(near_copies.bands(near_copies.shingle_set(t))) for t in pair)
        if not one & two:
            rows += [(len(rows) + k, t, "s") for k, t in enumerate(pair)]
    assert len(rows) > 20
    assert sorted(r.doc_id for r in near_copies.keep_one_each(docs(spark, rows)).collect()) == list(range(0, len(rows), 2))


def overlapping(n, seed=2):
    """Texts of few lines, most of which are common; many pairs are just below or above the bound."""
    rng = np.random.default_rng(seed)
    lines = [" ".join(f"l{k}w{x}" for x in range(6)) for k in range(14)]
    texts = [" ".join(lines[k] for k in sorted(rng.choice(14, int(rng.integers(8, 13)), replace=False))) for _ in range(n)]
    return [t + (f" own{i % 3}" if i % 4 else "") for i, t in enumerate(texts)]


def test_parted_pairs_hold_every_link_between_components(spark, monkeypatch):
    """Hot shingles, in blocks of a few members, with and without an order that puts them last."""
    texts = overlapping(120)
    frame = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    sets = {tuple(near_copies.shingle_set(t).tolist()) for t in texts}
    node = {s: near_copies._signed([near_copies.xxh64_intdigest(np.array(s, dtype=np.uint64).tobytes(), near_copies.SEED)])[0] for s in sets}
    want = {
        tuple(sorted((int(node[a]), int(node[b])))) for a in sets for b in sets
        if a < b and 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b))}
    none = spark.createDataFrame([], "node long, root long")
    assert len(want) > 10
    for block, last in ((4, None), (2048, near_copies.frequent_shingles(frame))):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        rows = near_copies.signatures(frame, last)
        nodes = rows.dropDuplicates(["node"])
        got = {(r.a, r.b) for r in near_copies.parted_pairs(rows, nodes, none).collect()}
        assert want <= got and len(got) < len(node) * (len(node) - 1) / 2
    first = min(node.values())
    joined = spark.createDataFrame([(int(x), int(first)) for x in node.values()], "node long, root long")
    assert near_copies.parted_pairs(rows, nodes, joined).count() == 0


def test_similar_sets_share_a_shingle_of_their_prefixes():
    rng = np.random.default_rng(3)
    last = rng.permutation(np.arange(0, 60, 2, dtype=np.uint64))
    rank = np.argsort(last)
    for _ in range(3000):
        one = rng.choice(120, int(rng.integers(1, 40)), replace=False).astype(np.uint64)
        two = np.union1d(one[int(rng.integers(0, 3)) :], rng.choice(120, int(rng.integers(0, 4)), replace=False).astype(np.uint64))
        one, two = np.unique(one), np.unique(two)
        if len(two) and 5 * len(np.intersect1d(one, two)) >= 4 * len(np.union1d(one, two)):
            assert len(np.intersect1d(near_copies.prefix(one, last[rank], rank), near_copies.prefix(two, last[rank], rank)))


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(4)
    for n in (3, 200, 257, 700, 5000):
        one = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for lost in (0, n // 9, n // 2):
            two = np.union1d(one[lost:], rng.integers(0, 2**63, n // 8, dtype=np.uint64))
            x, y = near_copies.parity(one), near_copies.parity(two)
            for words in {4, min(len(x), len(y))}:
                differ = np.bitwise_count(near_copies.folded(x, words) ^ near_copies.folded(y, words)).sum(dtype=np.int64)
                assert differ <= len(np.setxor1d(one, two))
