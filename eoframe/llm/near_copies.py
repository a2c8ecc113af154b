"""Near copies: SimHash fingerprints of five-word shingles propose pairs, by anchors and by bands; exact similarity of the shingle sets decides.

What these leave apart is compared wherever two sets share one of their first shingles in a common order. Sets that are alike always
do (prefix filter), so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from eoframe.llm.components import connected
from eoframe.llm.simhash import Sketch, anchor_links, majority, shingle_hashes
from eoframe.llm.tables import count_parts, free_name, materialize, text_hash

SHINGLE, SEED = 5, 42
#: Sets are near copies at this similarity (5 of 4: shared / all >= 4 / 5), in whole numbers.
SHARED, OF = 4, 5
#: A band holds the least of ``PER_BAND`` orders of the set; two sets at similarity 0.8 have a band in common with 0.995.
BANDS, PER_BAND = 10, 4
#: Fingerprints of 256 bits. At similarity 0.8 some 39 to 48 differ (sets of a few shingles differ in more), at most 6 more per
#: standard deviation; unlike sets differ in 128. The bound only spares exact checks.
WORDS, MOST = 4, 72
#: Members of a band nearer than this to the most central one (similarity 0.92 on average) are checked against it alone.
CLOSE = 24
#: Members of a band up to this number are all proposed to each other; the members beyond are linked by this many forests.
FEW, FORESTS = 16, 3
#: Pairs of members looked at together, which bounds a task's memory however large a band is.
PAIRS_AT_ONCE = 1 << 18
ROWS_PER_PART = 1 << 20
#: Shingles that several of about ``DRAWN`` texts hold come last in the order of shingles, at most ``FREQUENT`` of them. What is drawn
#: decides how many pairs are compared, and no link.
DRAWN, FREQUENT = 8192, 1 << 16
#: Members of a shingle beyond this number are compared in a grid of blocks with as many a side.
BLOCK = 2048
#: A table of texts to look up is sent to all tasks up to this number of rows (16 bytes each), and joined by sort beyond.
SENT = 1 << 16
ODD = [f"odd{w}" for w in range(4)]
#: The first word of the fingerprint is linked at anchors of the covering code, as op9 does, which finds every pair within two bits.
ANCHORED = Sketch(shingle=SHINGLE, seed=SEED)

_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 2**63, BANDS * PER_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 2**63, BANDS * PER_BAND, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a whole text's five-word shingles, ascending; empty without words."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE, SEED), dtype=np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """The keys of a set: per band a hash of the least hashes of the set in the band's orders."""
    least = np.full(BANDS * PER_BAND, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * _FACTORS + _OFFSETS
        np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0), out=least)
    rows = least.reshape(BANDS, PER_BAND)
    return [xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)]


def parity(hashes: np.ndarray) -> np.ndarray:
    """About as many bits as hashes (256 at least), each set if an odd number of the hashes fall on it: two sets differ in no fewer
    hashes than their bits do. Sets with little in common differ in about half of the bits."""
    width = min(max(256, 1 << (len(hashes) - 1).bit_length() if len(hashes) else 0), 1 << 16)
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The same as the parity on fewer bits."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def prefix(hashes: np.ndarray, told: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first of a set's hashes in the order: by value, but those in ``told`` (ascending) after all others, by ``rank``. Similar sets
    share SHARED / OF of the larger one at least, so if each lacks one hash less than that at its end, they have one in common."""
    k = len(hashes) - -(-SHARED * len(hashes) // OF) + 1
    if not len(told):
        return hashes[:k]
    at = np.minimum(np.searchsorted(told, hashes), len(told) - 1)
    common = told[at] == hashes
    late = hashes[common][np.argsort(rank[at[common]])]
    return np.concatenate([hashes[~common][:k], late])[:k]


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Hashes of the shingles that several of the drawn texts hold, rarest first."""
    every = count_parts(docs.count(), DRAWN)
    drawn = docs.where(F.pmod(text_hash(F.col("text")), F.lit(every)) == 0).select(F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py()).view(np.int64))], ["hash"])

    counts = drawn.mapInArrow(run, "hash long").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    most = counts.orderBy(F.desc("n"), "hash").limit(FREQUENT).toArrow()
    return np.ascontiguousarray(most.column("hash").to_numpy()[::-1]).view(np.uint64)


def _parted(one: bytes, two: bytes) -> int:
    """How many bits of the parities differ."""
    x, y = np.frombuffer(one, dtype="<u8"), np.frombuffer(two, dtype="<u8")
    words = min(len(x), len(y))
    if len(x) != len(y):
        x, y = folded(x, words), folded(y, words)
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame, last: np.ndarray | None = None) -> DataFrame:
    """doc_id, digest, node (tells the text's shingle set), n (its size), fp0, ..., odd0, ... (the parity on 256 bits), bands and prefix
    (arrays), and the parity of every row.
    The hashes ``last`` come last in the order of shingles, as they stand."""
    last = np.empty(0, dtype=np.uint64) if last is None else last
    rank = np.argsort(last)
    told = last[rank]
    fps = [f"fp{w}" for w in range(WORDS)] + ODD
    lists = [("bands", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))]
    schema = pa.schema([(c, pa.int64()) for c in ["doc_id", "digest", "node", "n", *fps]] + [*lists, ("parity", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, prints, keys, firsts, odd = [], [], [], [], [], []
            for text in batch.column(2):
                own = shingle_set(text.as_py())
                node.append(xxh64_intdigest(own.tobytes(), SEED))
                size.append(len(own))
                bits = parity(own)
                odd.append(bits.tobytes())
                prints.append([*(majority(own, WORDS) if len(own) else [0] * WORDS), *folded(bits, len(ODD)).tolist()])
                keys.append(_signed(bands(own)))
                firsts.append(prefix(own, told, rank).view(np.int64) if len(own) else [])
            prints = np.array(prints, dtype=np.uint64).reshape(-1, len(fps)).view(np.int64)
            columns = [pa.array(_signed(node)), pa.array(size, pa.int64()), *(pa.array(np.ascontiguousarray(prints[:, w])) for w in range(len(fps)))]
            columns += [pa.array(a, pa.list_(pa.int64())) for a in (keys, firsts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns, pa.array(odd, pa.binary())], schema=schema)

    ddl = "doc_id long, digest long, node long, n long, " + ", ".join(f"{c} long" for c in fps) + ", bands array<long>, prefix array<long>, parity binary"
    named = docs.select(F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("digest"), F.col("text").cast("string"))
    return named.mapInArrow(run, ddl)


def _differ(fps: np.ndarray, other: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(fps[:, w, None] ^ other[None, :, w]).astype(np.uint16) for w in range(fps.shape[1]))


def _alike_in_size(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return OF * np.minimum(a, b) >= SHARED * np.maximum(a, b)


def _central(fps: np.ndarray) -> int:
    """The member nearest to the bits that most members have."""
    ones = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1).sum(axis=0, dtype=np.int64)
    middle = np.packbits(2 * ones > len(fps)).view(np.uint64)[None, :]
    return int(np.argmin(_differ(fps, middle)[:, 0]))


def proposals(fps: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of members of one band that are to be checked.

    A few members: all pairs within the bounds. More: while some lie close around a centre these are proposed to it; of what is
    left, and the centres, the nearest pairs that join ``FORESTS`` edge-disjoint forests. So no more than a few pairs per member
    are proposed, and near copies are parted only where every forest's path between them fails the exact check.
    """
    u = np.ascontiguousarray(fps).view(np.uint64)
    out, left, centres = [], np.arange(len(u)), []
    while len(left) > FEW:
        centre = left[_central(u[left])]
        near = (_differ(u[left], u[centre : centre + 1])[:, 0] <= CLOSE) & _alike_in_size(sizes[left], sizes[centre])
        if near.sum() < 2:
            break
        out += [(int(centre), int(x)) for x in left[near] if x != centre]
        centres.append(centre)
        left = left[~near]
    left = np.concatenate([left, np.array(centres, dtype=np.int64)])
    if len(left) <= FEW:
        return out + [(int(left[i]), int(left[j])) for block in _fitting(u, sizes, left) for _, i, j in block]
    kept, spanned = np.empty((0, 3), dtype=np.int64), None
    for block in _fitting(u, sizes, left):
        if spanned is not None:  # what the last forest joins by nearer pairs is in no forest
            tree, longest = spanned
            block = block[(tree[block[:, 1]] != tree[block[:, 2]]) | (block[:, 0] < longest[tree[block[:, 1]]])]
        if len(block):
            kept, spanned = _forests(np.concatenate([kept, block]), len(left))
    return out + [(int(left[i]), int(left[j])) for _, i, j in kept]


def _fitting(u: np.ndarray, sizes: np.ndarray, left: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of ``left`` within the bounds, in blocks of about ``PAIRS_AT_ONCE``: bits that differ and the places of both."""
    rows = max(1, PAIRS_AT_ONCE // max(len(left), 1))
    for at in range(0, len(left), rows):
        block = left[at : at + rows]
        apart = _differ(u[block], u[left[at:]])
        fit = (apart <= MOST) & _alike_in_size(sizes[block][:, None], sizes[left[at:]][None, :])
        i, j = np.nonzero(np.triu(fit, 1))
        yield np.stack([apart[i, j].astype(np.int64), at + i, at + j], axis=1)


def _forests(pairs: np.ndarray, n: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The pairs in ``FORESTS`` edge-disjoint forests, nearest first (equally near: by place), and of the last forest each member's
    tree and each tree's longest pair. A pair that some pairs keep out of all forests is kept out by more pairs too, so the pairs may
    come in blocks, of which only those in forests are held."""
    pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
    parents, stay = [list(range(n)) for _ in range(FORESTS)], []

    def root(parent: list[int], x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    longest = np.zeros(n, dtype=np.int64)
    for row, (apart, a, b) in enumerate(pairs.tolist()):
        for parent in parents:
            x, y = root(parent, a), root(parent, b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                stay.append(row)
                if parent is parents[-1]:
                    longest[min(x, y)] = apart  # pairs come by length, so the last one is the longest
                break
    return pairs[stay], (np.array([root(parents[-1], x) for x in range(n)]), longest)


def proposed_pairs(nodes: DataFrame) -> DataFrame:
    """``nodes``: node, n, fp0, ..., bands, one row for each shingle set. Distinct pairs (a < b) to be checked. A band's members
    meet in one task as numbers (56 bytes each); what moves is ``BANDS`` such rows for each node, whatever the number of nodes."""
    fps = [f"fp{w}" for w in range(WORDS)]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) for b in batches if b.num_rows]
        if not held:
            return
        rows = np.concatenate(held)
        held.clear()
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(rows[:, 0])) + 1, [len(rows)]])
        pairs = []
        for k in np.flatnonzero(np.diff(starts) > 1):
            group = rows[starts[k] : starts[k + 1]]
            pairs += [(min(p), max(p)) for p in ((int(group[x, 1]), int(group[y, 1])) for x, y in proposals(group[:, 3:], group[:, 2]))]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], schema=schema)

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, count_parts(nodes.count() * BANDS, ROWS_PER_PART))
    keyed = nodes.where("n > 0").select(F.explode("bands").alias("key"), "node", "n", *fps)
    return keyed.repartition(parts, "key").mapInArrow(compare, "a long, b long").distinct()


def anchored_pairs(nodes: DataFrame) -> DataFrame:
    """``nodes``: node, n, fp0, one row for each shingle set. Pairs (a < b) whose first words differ in two bits or fewer, as many as
    connect all of these: fingerprints meet at anchors of the covering code, sets with one fingerprint are joined to their first."""
    some = nodes.where("n > 0").select("node", "fp0")
    first = materialize(some.groupBy("fp0").agg(F.min("node").alias("first")), "first-of-fingerprint")
    same = some.join(first, "fp0").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = anchor_links(first.select(F.col("first").alias("node"), "fp0"), ANCHORED)
    return same.union(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def parted_pairs(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of nodes of different components (``roots``: node, root; a node that is absent is its own) that can be
    near copies: all that share a shingle of their prefixes and are not told apart by their sizes or parities.

    Most shingles of a prefix belong to one component only and are dropped by a window that may spill. Those that are left are
    compared as numbers; the members of a hot one lie in a grid, so a task holds no more than its blocks.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    names = ["token", "lo", "hi", "side", "node", "root", "n", *ODD]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parities = [], []
        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]], axis=1))
                parities += batch.column(len(names)).to_pylist()
        if not held:
            return
        x = np.concatenate(held)
        held.clear()
        place = np.lexsort((x[:, 2], x[:, 1], x[:, 0]))
        x = x[place]
        group = np.concatenate([[0], np.cumsum((np.diff(x[:, :3], axis=0) != 0).any(axis=1))])
        side, node, root, n, odd = x[:, 3], x[:, 4], x[:, 5], x[:, 6], x[:, 7:].view(np.uint64)
        whole, i, apart = x[:, 1] == x[:, 2], np.arange(len(x)), 0
        while len(i):  # all pairs of rows of a block, by how far apart they lie
            apart += 1
            i = i[i + apart < len(x)]
            i = i[group[i] == group[i + apart]]
            for at in range(0, len(i), PAIRS_AT_ONCE):
                a = i[at : at + PAIRS_AT_ONCE]
                b = a + apart
                fit = (root[a] != root[b]) & (whole[a] | (side[a] != side[b])) & _alike_in_size(n[a], n[b])
                a, b = a[fit], b[fit]
                differ = np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64)
                fit = (OF + SHARED) * differ <= (OF - SHARED) * (n[a] + n[b])
                a, b = a[fit], b[fit]
                ends, first = np.unique(np.sort(np.stack([node[a], node[b]], axis=1), axis=1), axis=0, return_index=True)
                a, b = a[first], b[first]
                differ = np.array([_parted(parities[i], parities[j]) for i, j in zip(place[a].tolist(), place[b].tolist())], dtype=np.int64)
                ends = ends[(OF + SHARED) * differ <= (OF - SHARED) * (n[a] + n[b])]
                if len(ends):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, k])) for k in (0, 1)], schema=schema)

    own = rows.where("n > 0").select("node", "prefix").join(roots, "node", "left")
    spread = own.select(F.explode("prefix").alias("token"), "node", F.coalesce("root", "node").alias("root"))
    same = Window.partitionBy("token")
    met = spread.withColumns({"least": F.min("root").over(same), "most": F.max("root").over(same), "members": F.count(F.lit(1)).over(same)})
    met = met.where("least <> most").select("token", "node", "root", F.ceil(F.col("members") / BLOCK).alias("grid"))
    met = materialize(met.distinct(), "shared-shingles")
    side = met.join(nodes.select("node", "n", *ODD, "parity"), "node").withColumn("side", F.pmod(F.xxhash64("node"), F.col("grid")))
    other = side.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("grid") - 1)))
    blocks = other.withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")}).select(*names, "parity")
    parts = count_parts(met.agg(F.sum("grid")).first()[0] or 0, ROWS_PER_PART // 4)
    parts = max(parts, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(parts, "token", "lo", "hi").mapInArrow(compare, "a long, b long").distinct()


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``: node and the digest of a text. node and its shingle set (array), one row each."""
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    texts = docs.select(text_hash(F.col("text")).alias("digest"), F.col("text").cast("string").alias("text"))
    sets = texts.join(wanted, "digest").select("node", "text").mapInArrow(run, "node long, hashes array<long>")
    return sets.groupBy("node").agg(F.first("hashes").alias("hashes"))


def checked_links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs those whose sets have the similarity: shared shingles over all shingles, exactly."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(nodes.join(ends, "node", "left_semi").select("node", "digest"), "checked-nodes")
    wanted = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    sets = materialize(_sets(docs, wanted), "shingle-sets")
    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.where(OF * shared >= SHARED * (F.size("ha") + F.size("hb") - shared)).select("a", "b")


def over_roots(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links of nodes as links of their components."""
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), "root")
        links = links.join(own, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    return links.select("a", "b")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The documents with the smallest id of each component of near copies, with all their columns.

    Texts are near copies if their sets of five-word shingles (of the whole text; fewer words: the whole sequence) have at least
    four fifths in common; copies of copies belong together. A null text equals the empty one, and texts without words are one
    set. A document is told by its id and its text, so an id may be null (the last of its component) or stand for several texts
    (of those in one component one stays). Rows that repeat id and text stay or go together.
    """
    rows = materialize(signatures(docs, frequent_shingles(docs)), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("first")
    rest = [F.first(c).alias(c) for c in ["n", *[f"fp{w}" for w in range(WORDS)], *ODD, "bands", "parity"]]
    nodes = materialize(rows.groupBy("node").agg(least, F.min("digest").alias("digest"), *rest), "signature-nodes")
    pairs = materialize(anchored_pairs(nodes).union(proposed_pairs(nodes)).distinct(), "proposed-pairs")
    roots = materialize(connected(checked_links(docs, nodes, pairs)), "components")
    parted = materialize(parted_pairs(rows, nodes, roots), "parted-pairs")
    placed = nodes.select("node", "first").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    wider = connected(over_roots(checked_links(docs, nodes, parted), roots)).select(F.col("node").alias("root"), F.col("root").alias("wider"))
    placed = placed.join(wider, "root", "left").select(F.coalesce("wider", "root").alias("root"), "first")
    other, other_digest, digest = (free_name(docs, n) for n in ("_id", "_sha", "_digest"))
    stay = placed.groupBy("root").agg(F.min("first").alias("first"))
    stay = materialize(stay.select(F.col("first.doc_id").alias(other), F.col("first.digest").alias(other_digest)), "documents-kept")
    same = F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(digest) == F.col(other_digest))
    return docs.withColumn(digest, text_hash(F.col("text"))).join(stay, same, "left_semi").select(*docs.columns)
