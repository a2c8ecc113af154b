"""Removing byte strings that occur elsewhere, by a common-prefix-aware distributed merge sort of suffixes.

A string of ``length`` bytes is judged at its anchor: the place in it where the hash of ``GRAM`` bytes is least. Equal strings have
equal anchors, so only suffixes at anchors are sorted. Anchors whose gram occurs once in the corpus are left out beforehand
(duplicate detection on hashes). Each task sorts its suffixes, writes them as front-coded runs and deals these by gram; a loser
tree merges the runs and compares strings only beyond what they are known to share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe.llm.tables import count_parts, materialize

LENGTH = 200
GRAM = 32
#: Bytes of one text that are looked at together, and suffixes in one sorted run.
BYTES_AT_ONCE, RUN = 1 << 21, 100_000
#: Suffixes merged by one task, about.
MERGED = 40_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
PLACE = np.dtype([("key", "<i8"), ("lo", "<i8"), ("hi", "<i8")])


def _letters() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


_LETTER = _letters()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from every position on."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * _powers(_BASE, n), out=sums[1:])
    h = (sums[size:] - sums[:-size]) * _powers(_BACK, n)[: n - size + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over every ``width`` neighbours, in two passes over blocks of that width."""
    n, fill = len(a), a[-1]
    blocks = np.full(-(-n // width) * width, fill, dtype=a.dtype)
    blocks[:n] = a
    blocks = blocks.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor positions, hash of the gram there, and first and last start of the strings of ``length`` bytes that have it."""
    h = string_hashes(data, gram)
    width = length - gram + 1
    least = _sliding(h, width, np.minimum)
    edge = np.zeros(width - 1, dtype=np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum)[: len(h)] == h)
    starts = np.arange(len(least))
    at = np.searchsorted(chosen, starts)
    wrong = np.flatnonzero(h[chosen[at]] != least)
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[h[chosen[at[wrong]]] != least[wrong]]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    places = chosen[at[first]]
    return places, h[places], first, last


def _slices(size: int, length: int) -> Iterator[tuple[int, int]]:
    """Parts of a text that share no start of a string."""
    for a in range(0, max(0, size - length + 1), BYTES_AT_ONCE):
        yield a, min(size, a + BYTES_AT_ONCE + length - 1)


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes."""
    n, h = min(len(a), len(b)), known
    while h < n:
        x, y = a[h : h + 32], b[h : h + 32]
        if x == y:
            h += 32
            continue
        m = min(len(x), len(y))
        x, y = int.from_bytes(x[:m], "big"), int.from_bytes(y[:m], "big")
        return h + m - (-(-(x ^ y).bit_length() // 8))
    return n


class Run:
    """A front-coded sorted run: each suffix is the bytes it shares with the one before, and its own rest."""

    def __init__(self, shared: bytes, rests: bytes, heads: bytes, counts: bytes, tails: bytes, places: bytes):
        self.shared = np.frombuffer(shared, "<u2").tolist()
        self.rests = np.frombuffer(rests, "<u2").tolist()
        self.heads = np.frombuffer(heads, "<u2").tolist()
        self.counts = np.frombuffer(counts, "<u4").tolist()
        self.tails = pa.decompress(tails, sum(self.rests), "zstd", asbytes=True)
        n_places = sum(self.counts) * PLACE.itemsize
        self.places = np.frombuffer(pa.decompress(places, n_places, "zstd", asbytes=True), PLACE)
        self.i, self.at, self.place, self.string = -1, 0, 0, b""

    @staticmethod
    def encode(items: list[tuple[bytes, int, np.ndarray]]) -> tuple[bytes, ...]:
        """(string, head, places) in sorted order; equal ones are one item."""
        shared, rests, heads, counts, tails, places, before = [], [], [], [], [], [], b""
        for string, head, place in items:
            k = common_prefix(before, string, 0)
            shared.append(k)
            rests.append(len(string) - k)
            heads.append(head)
            counts.append(len(place))
            tails.append(string[k:])
            places.append(place)
            before = string
        small = [np.array(x, "<u2").tobytes() for x in (shared, rests, heads)]
        large = [pa.compress(x, "zstd", asbytes=True) for x in (b"".join(tails), np.concatenate(places).tobytes())]
        return (*small, np.array(counts, "<u4").tobytes(), *large)

    def step(self) -> bool:
        """Goes to the next suffix; ``lcp`` is then what it shares with the one before."""
        if self.i >= 0:
            self.place += self.counts[self.i]
        self.i += 1
        if self.i >= len(self.shared):
            return False
        self.lcp, n = self.shared[self.i], self.rests[self.i]
        self.string = self.string[: self.lcp] + self.tails[self.at : self.at + n]
        self.at += n
        self.head = self.heads[self.i]
        return True

    def here(self) -> np.ndarray:
        return self.places[self.place : self.place + self.counts[self.i]]


def merge_runs(runs: list[Run]) -> Iterator[tuple[bytes, int, int, list[np.ndarray]]]:
    """Merges sorted runs with a loser tree. Yields each distinct (string, head), what the string shares with the string before,
    and its places. A player keeps what its string shares with the last winner; two players whose shared lengths differ are told
    apart by these alone, and otherwise strings are compared only beyond that length."""
    size = 1
    while size < len(runs):
        size *= 2
    alive = [r.step() for r in runs] + [False] * (size - len(runs))
    lcp = [0] * size
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes the one with the winner."""
        if not alive[b]:
            return a, b
        if not alive[a]:
            return b, a
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        x, y = runs[a], runs[b]
        k = common_prefix(x.string, y.string, lcp[a])
        if k < len(x.string) and k < len(y.string):
            first = x.string[k] < y.string[k]
        elif len(x.string) != len(y.string):
            first = len(x.string) < len(y.string)
        else:
            first = (x.head, a) < (y.head, b)
        winner, loser = (a, b) if first else (b, a)
        lcp[loser] = k
        return winner, loser

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if size > 1 else 0
    held: tuple[bytes, int, int, list[np.ndarray]] | None = None
    while alive[winner]:
        run = runs[winner]
        if held and run.string == held[0] and run.head == held[1]:
            held[3].append(run.here())
        else:
            if held:
                yield held
            held = (run.string, run.head, lcp[winner], [run.here()])
        alive[winner] = run.step()
        if alive[winner]:
            lcp[winner] = run.lcp
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
    if held:
        yield held


def repeated_places(runs: list[Run], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, start and stop of byte ranges covered by strings that occur twice, among the suffixes of these runs."""
    out: list[np.ndarray] = []
    group: list[tuple[bytes, int, int, list[np.ndarray]]] = []
    open_groups: list[tuple[bytes, int, np.ndarray]] = []  # suffixes of groups that have a single one beside others

    def close() -> None:
        if len(group) > 1 and any(sum(map(len, g[3])) == 1 for g in group):
            open_groups.extend((s, head, places[0]) if sum(map(len, places)) == 1 else (s, head, places[0][:0])
                               for s, head, _, places in group)
        for _, _, _, places in group:
            if sum(map(len, places)) > 1:
                out.extend(places)

    for item in merge_runs(runs):
        if group and item[2] < gram:
            close()
            group = []
        group.append(item)
    if group:
        close()
    whole = np.concatenate(out) if out else np.zeros(0, PLACE)
    keys, begins, ends = [whole["key"]], [whole["lo"]], [whole["hi"] + length]
    if open_groups:
        texts = [s[head:] + s[:head] for s, head, _ in open_groups]
        sizes = np.array([len(t) for t in texts])
        h = string_hashes(np.frombuffer(b"".join(texts), np.uint8), length)
        item = np.repeat(np.arange(len(texts)), sizes - length + 1)
        first = np.cumsum(sizes) - sizes
        within = np.arange(len(item)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1)
        own = h[first[item] + within]
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        twice = np.zeros(len(own), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        single = np.array([len(p) == 1 for _, _, p in open_groups])
        twice &= single[item]
        begin = twice & ~np.concatenate([[False], twice[:-1] & (item[1:] == item[:-1])])
        end = twice & ~np.concatenate([twice[1:] & (item[1:] == item[:-1]), [False]])
        b, e = np.flatnonzero(begin), np.flatnonzero(end)
        lone = np.concatenate([p if len(p) else np.zeros(1, PLACE) for _, _, p in open_groups])
        place = lone[item[b]]
        keys.append(place["key"])
        begins.append(place["lo"] + within[b])
        ends.append(place["lo"] + within[e] + length)
    return np.concatenate(keys), np.concatenate(begins), np.concatenate(ends)


def removed_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs``: key (long), text. Returns key, start, stop of byte ranges to remove; ranges of a key may overlap."""
    gram_schema = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("n", pa.int32())])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found, counts = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer((text.as_py() or "").encode("utf-8"), np.uint8)
                for a, b in _slices(len(data), length):
                    h, n = np.unique(anchors(data[a:b], length, gram)[1], return_counts=True)
                    found.append(h)
                    counts.append(n)
                    keys.append(np.full(len(h), key, dtype=np.int64))
            if found:
                columns = [np.concatenate(found).view(np.int64), np.concatenate(keys), np.concatenate(counts).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=gram_schema)

    once = materialize(docs.select("key", "text").mapInArrow(grams, "gram long, key long, n int"), "grams")
    often = once.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    often = once.select("gram", "key").join(materialize(often, "grams-repeated"), "gram")
    wanted = materialize(often.groupBy("key").agg(F.collect_set("gram").alias("grams")), "grams-of-texts")
    total = wanted.agg(F.sum(F.size("grams"))).first()[0] or 0
    parts = count_parts(total, MERGED)
    binary = ("shared", "rests", "heads", "counts", "tails", "places")
    run_schema = pa.schema([("part", pa.int64())] + [(n, pa.binary()) for n in binary])

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, tuple[int, int, int]]] = []

        def runs() -> Iterator[pa.RecordBatch]:
            held.sort()
            start = 0
            while start < len(held):
                part, items, i = held[start][0], [], start
                while i < len(held) and held[i][0] == part:
                    _, string, head, place = held[i]
                    if items and items[-1][0] == string and items[-1][1] == head:
                        items[-1][2].append(place)
                    else:
                        items.append((string, head, [place]))
                    i += 1
                coded = Run.encode([(s, head, np.array(p, dtype=PLACE)) for s, head, p in items])
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, *coded)], schema=run_schema)
                start = i
            held.clear()

        for batch in batches:
            for key, text, known in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode("utf-8")
                view, known = np.frombuffer(data, np.uint8), np.sort(known.values.to_numpy())
                for a, b in _slices(len(view), length):
                    at, h, lo, hi = anchors(view[a:b], length, gram)
                    h = h.view(np.int64)
                    i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    use = known[i] == h
                    part = (h[use].view(np.uint64) % np.uint64(parts)).tolist()
                    for p, x, l, r in zip(part, (at[use] + a).tolist(), (lo[use] + a).tolist(), (hi[use] + a).tolist()):
                        held.append((p, data[x : r + length] + data[l:x], r + length - x, (key, l, r)))
                if len(held) >= RUN:
                    yield from runs()
        yield from runs()

    texts = docs.select("key", "text").join(wanted, "key")
    coded = texts.select("key", "text", "grams").mapInArrow(sort_runs, "part long, " + ", ".join(f"{n} binary" for n in binary))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        runs = [Run(*row) for row in zip(*[rows[n] for n in binary])]
        keys, begins, ends = repeated_places(runs, length, gram)
        return pd.DataFrame({"key": keys, "start": begins, "stop": ends})

    return coded.groupBy("part").applyInPandas(merge, "key long, start long, stop long")


def union_ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of what the ranges cover."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate([[True], starts[1:] > stops[:-1]])
    first = np.flatnonzero(new)
    return starts[first], stops[np.concatenate([first[1:] - 1, [len(stops) - 1]])]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Removes every byte of a text that a ``length``-byte string covers which also starts elsewhere in the corpus.

    Returns doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), one row per input row. Null text counts as empty;
    texts shorter than ``length`` lose nothing; a text that overlaps itself (a period) loses what repeats. Rows that repeat id and
    text are places of their own, so all lose it. Ids may be null. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    ranges = removed_ranges(rows.select("key", "text"), length, gram)
    ranges = ranges.groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    joined = rows.select("key", "text", "doc_id").join(ranges, "key", "left").select("doc_id", "text", "starts", "stops")
    out = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for doc_id, text, starts, stops in zip(*[batch.column(i) for i in range(4)]):
                data, a, b = text.as_py().encode("utf-8"), [], []
                if starts.is_valid:
                    a, b = union_ranges(starts.values.to_numpy(), stops.values.to_numpy())
                kept = b"".join(data[x:y] for x, y in zip([0, *b], [*a, len(data)]))
                made.append((doc_id.as_py(), len(data), len(data) - len(kept), len(a), kept))
            columns = list(zip(*made)) or [[] for _ in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, out)], schema=pa.schema(out))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    joined = joined.withColumn("doc_id", F.col("doc_id").cast("long"))
    return joined.mapInArrow(cut, schema)
