"""SimHash near-duplicates by anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe.llm.components import connected
from eoframe.llm.tables import materialize

#: Groups at one anchor larger than this are compared by segments where few bits may differ.
COMPARED_WHOLE = 1024
HASHES_AT_ONCE = 1 << 16


@dataclass(frozen=True)
class Sketch:
    """How texts become fingerprints and which of these link.

    A fingerprint has ``words`` 64-bit words. The first ``anchored`` of them are cut into pieces of 2 ** ``code`` bits; the anchors of a piece are the words of
    the Hamming code of length 2 ** code - 1, with either value of the bit that is left. Every piece is within one flip of an
    anchor (the covering radius), and it is copied to all anchors within two, so two pieces that differ in at most one bit meet.
    Fingerprints link at ``most`` differing bits or fewer. None is missed while ``most`` is below twice the number of pieces;
    beyond that, a pair is missed only if it differs in two bits or more in every piece.
    """

    shingle: int = 3
    seed: int = 42
    words: int = 1
    anchored: int = 1
    code: int = 5
    most: int = 2

    @property
    def names(self) -> list[str]:
        return [f"fp{i}" for i in range(self.words)]


#: Three-word shingles, 64 bits, two of which may differ.
STRICT = Sketch()


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _another(hashes: np.ndarray, nth: int) -> np.ndarray:
    """The nth further hash made from a hash."""
    x = hashes + np.uint64(nth * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int, seed: int) -> list[int]:
    """XXH64 of every run of so many words of the whole text, repeats included; of all words where there are fewer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z alone are lower-cased, ASCII white space alone splits
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxh64_intdigest(joined, seed)]
    ends = list(accumulate([len(w) + 1 for w in words], initial=-1))
    return [xxh64_intdigest(joined[s + 1 : e], seed) for s, e in zip(ends, ends[shingle:])]


def fingerprint(text: str | None, sketch: Sketch = STRICT) -> list[int]:
    """The words of a whole text's fingerprint; 0 without words in the text."""
    hashes = shingle_hashes(text, sketch.shingle, sketch.seed)
    return majority(hashes, sketch.words) if hashes else [0] * sketch.words


def majority(hashes: Sequence[int], words: int) -> list[int]:
    """Words of 64 bits that are set where over half the hashes, or for the further words hashes made from these, have them."""
    ones = np.zeros((words, 64), dtype=np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part = np.array(hashes[at : at + HASHES_AT_ONCE], dtype=np.uint64)
        for w in range(words):
            ones[w] += _bits(_another(part, w) if w else part)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprints(docs: DataFrame, sketch: Sketch = STRICT) -> DataFrame:
    """doc_id and the fingerprint's words (fp0, ..., as signed longs) of every row."""
    schema = pa.schema([(n, pa.int64()) for n in ["doc_id", *sketch.names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), sketch) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            columns = [pa.array(found[:, w]) for w in range(sketch.words)] if len(found) else [pa.array([], pa.int64())] * sketch.words
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    told = ", ".join(f"{n} long" for n in ["doc_id", *sketch.names])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, told)


def _syndromes(pieces: np.ndarray, length: int) -> np.ndarray:
    """Of the ``length`` low bits: the exclusive or of the positions (from 1) of the bits that are set; 0 for a code word."""
    out = np.zeros(len(pieces), dtype=np.int64)
    for p in range(1, length + 1):
        out ^= np.where(pieces >> (p - 1) & 1, p, 0)
    return out


def near_anchors(pieces: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
    """Every anchor within two flips of each piece, its nearest one first: row numbers and anchors."""
    length = (1 << code) - 1
    s, rows = _syndromes(pieces, length), np.arange(len(pieces))
    home = pieces ^ np.where(s > 0, np.left_shift(1, np.maximum(s, 1) - 1), 0)
    at, anchors = [rows, rows], [home, home ^ (1 << length)]
    off = np.flatnonzero(s > 0)
    for i in range(1, length + 1):
        j = s[off] ^ i  # flipping positions i and j, whose exclusive or is the syndrome
        use = off[j > i]
        at.append(use)
        anchors.append(pieces[use] ^ (1 << (i - 1)) ^ np.left_shift(1, (s[use] ^ i) - 1))
    return np.concatenate(at), np.concatenate(anchors)


def anchor_rows(fps: np.ndarray, anchored: int, code: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and row numbers: each fingerprint (a row of words) at every anchor near one of its pieces. A key tells the piece's
    place and the anchor."""
    keys, found, width = [], [], 1 << code
    unsigned = np.ascontiguousarray(fps).view(np.uint64)
    per_word = 64 // width
    for word in range(anchored):
        for k in range(per_word):
            piece = unsigned[:, word] >> np.uint64(k * width) & np.uint64((1 << width) - 1)
            at, anchors = near_anchors(piece.astype(np.int64), code)
            keys.append(anchors << 8 | (word * per_word + k))
            found.append(at)
    return np.concatenate(keys), np.concatenate(found)


class _Sets:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _close(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    differ = np.zeros((len(a), len(b)), dtype=np.uint16)
    for w in range(a.shape[1]):
        differ += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return np.nonzero(differ <= most)


def group_links(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (row numbers) among the distinct fingerprints of one anchor that span what they connect: fewer than there are rows.

    A large group is cut by ``most`` + 1 segments of the first word (so many flips leave one untouched) before pairs are looked
    at, where these are wide enough.
    """
    sets, links, u = _Sets(len(fps)), [], np.ascontiguousarray(fps).view(np.uint64)
    parts = [np.arange(len(u))]
    if len(u) > COMPARED_WHOLE and u.shape[1] == 1 and most <= 3:
        parts, width = [], 64 // (most + 1)
        for k in range(most + 1):
            segment = u[:, 0] >> np.uint64(k * width) & np.uint64((1 << width) - 1)
            order = np.argsort(segment, kind="stable")
            parts += [p for p in np.split(order, np.flatnonzero(np.diff(segment[order])) + 1) if len(p) > 1]
    for part in parts:
        own = u[part]
        for a in range(0, len(own), 64):  # a block against itself and what follows
            for b in range(a, len(own), 8192):
                i, j = _close(own[a : a + 64], own[b : b + 8192], most)
                after = i + a < j + b
                x, y = part[a + i[after]], part[b + j[after]]
                if len(x) > len(own[b : b + 8192]):  # most of these are joined already, and not made Python numbers
                    roots = np.zeros(len(u), dtype=np.int64)
                    for members in (part[a : a + 64], part[b : b + 8192]):
                        roots[members] = [sets.root(m) for m in members.tolist()]
                    x, y = x[roots[x] != roots[y]], y[roots[x] != roots[y]]
                for x, y in zip(x.tolist(), y.tolist()):
                    if sets.join(x, y):
                        links.append((x, y))
    return links


def anchor_links(nodes: DataFrame, sketch: Sketch = STRICT) -> DataFrame:
    """``nodes``: node (long) and a distinct fingerprint. Links (a, b) between nodes that connect all pairs that meet at an
    anchor and differ in few enough bits. The fingerprints of an anchor are compared in one task, which holds them as numbers;
    it yields fewer links than there are fingerprints, never all pairs."""
    names = ["node", *sketch.names]
    rows_schema = pa.schema([("key", pa.int64())] + [(n, pa.int64()) for n in names])
    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def table(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = table(batch)
            for r in range(0, len(rows), 4096):
                keys, at = anchor_rows(rows[r : r + 4096, 1:], sketch.anchored, sketch.code)
                for s in range(0, len(keys), 65536):
                    part = rows[r + at[s : s + 65536]]
                    columns = [keys[s : s + 65536], *(np.ascontiguousarray(part[:, c]) for c in range(part.shape[1]))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=rows_schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [table(b) for b in batches if b.num_rows]
        if not held:
            return
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(rows[:, 0])) + 1])
        ends = np.concatenate([starts[1:], [len(rows)]])
        several = ends - starts > 1
        links = [(int(rows[s + x, 1]), int(rows[s + y, 1]))
                 for s, e in zip(starts[several].tolist(), ends[several].tolist())
                 for x, y in group_links(rows[s:e, 2:], sketch.most)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], schema=link_schema)

    told = ", ".join(f"{n} long" for n in ["key", *names])
    replicas = nodes.select(*names).mapInArrow(replicate, told)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return replicas.repartition(parts, "key").mapInArrow(compare, "a long, b long").distinct()


def _placed(rows: DataFrame, first: Column, sketch: Sketch) -> tuple[DataFrame, DataFrame]:
    """``rows``: node and fingerprint. Tables of node and root, and of root and the least ``first`` of its component's rows."""
    nodes = materialize(rows.groupBy("node", *sketch.names).agg(F.min(first).alias("first")), "fingerprint-nodes")
    roots = connected(anchor_links(nodes, sketch))
    placed = nodes.select("node", "first").join(roots, "node", "left")
    placed = materialize(placed.select("node", "first", F.coalesce("root", "node").alias("root")), "fingerprint-roots")
    return placed, placed.groupBy("root").agg(F.min("first").alias("first"))


def _with_node(rows: DataFrame, sketch: Sketch) -> DataFrame:
    return rows.withColumn("node", F.col("fp0") if sketch.words == 1 else F.xxhash64(*sketch.names))


def near_duplicates(docs: DataFrame, sketch: Sketch = STRICT) -> DataFrame:
    """doc_id, the fingerprint's words and component_id (smallest doc_id reachable over links) of every row.

    Equal fingerprints are one node, whatever the number of copies; texts without words have fingerprint 0 and link like any
    other. A null doc_id belongs to its text's component and is never its smallest id unless it is the only one. Rows that
    repeat stay as they are; an empty table gives no rows; other columns play no part.
    """
    names = sketch.names
    rows = materialize(_with_node(fingerprints(docs, sketch), sketch), "fingerprints")
    placed, least = _placed(rows, F.col("doc_id"), sketch)
    # written, so that the join below has two plain tables and Spark can split a component with very many fingerprints
    least = materialize(least.withColumnRenamed("first", "component_id"), "component-ids")
    named = materialize(placed.join(least, "root").select("node", "component_id"), "fingerprint-components")
    return rows.join(named, "node").select("doc_id", *names, "component_id")
