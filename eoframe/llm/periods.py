"""Periodic runs of words: longest common extensions from difference-cover samples, asked on a harmonic grid of positions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run is at least this long and holds its period at least this often.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Every difference modulo ``MODULUS`` is one of two members of ``COVER`` (31 = 5 * 5 + 5 + 1, a perfect difference set).
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Grid points that are asked at once.
ASKED = 1 << 20


@cache
def shifts() -> np.ndarray:
    """By the remainders of two positions: by how many words both move on to be sampled."""
    inside = np.zeros(MODULUS, dtype=bool)
    inside[list(COVER)] = True
    out = np.full((MODULUS, MODULUS), -1, dtype=np.int16)
    for a in range(MODULUS):
        for b in range(MODULUS):
            out[a, b] = next(s for s in range(MODULUS) if inside[(a + s) % MODULUS] and inside[(b + s) % MODULUS])
    return out


def words_alike(ids: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words are the same from i and j on, at most ``most``; ``ids`` ends with padding."""
    same = np.zeros(len(i), dtype=np.int64)
    alive = np.flatnonzero(most > 0)
    for step in count():
        alive = alive[ids[i[alive] + step] == ids[j[alive] + step]]
        if not len(alive):
            return same
        same[alive] = step + 1
        alive = alive[most[alive] > step + 1]


class Extensions:
    """Answers how far the words from two positions on agree.

    Only suffixes at positions whose remainder lies in the cover are sorted (by their first ``MODULUS`` words, then by doubling,
    as a sampled position plus ``MODULUS`` is sampled again); a range-minimum table over their common prefixes is kept. A query
    compares the few words up to the next pair of sampled positions and looks up the rest. Built when first needed.
    """

    def __init__(self, ids: np.ndarray):
        """``ids``: a number of 1 or more for each word."""
        self.n = len(ids)
        self.ids = np.concatenate([ids, np.zeros(2 * MODULUS, dtype=ids.dtype)])  # what lies beyond the end equals no word
        self.ready = False

    def _build(self) -> None:
        self.ready = True
        n, ids = self.n, self.ids
        at = (np.arange(0, n + MODULUS, MODULUS)[:, None] + np.array(COVER)[None]).ravel()
        at = at[at < n]
        m = len(at)
        self.index = np.full(n + 1, -1, dtype=np.int32)
        self.index[at] = np.arange(m, dtype=np.int32)
        bits = max(int(ids.max()).bit_length(), 1)
        each = max(62 // bits, 1)  # words that are compared as one number
        columns = []
        for a in range(0, MODULUS, each):
            column = np.zeros(m, dtype=np.int64)
            for k in range(a, min(a + each, MODULUS)):
                column = (column << bits) | ids[at + k]
            columns.append(column)
        order = np.lexsort(columns[::-1])
        new = np.zeros(m, dtype=bool)
        new[:1] = True
        for column in columns:
            new[1:] |= column[order[1:]] != column[order[:-1]]
        rank = np.empty(m + 1, dtype=np.int32)  # the last place stands for all positions beyond the end
        rank[order] = np.cumsum(new)
        rank[m] = 0
        levels, span = [rank], MODULUS
        while levels[-1].max() < m:
            ahead = at + span
            ahead = np.where(ahead < n, self.index[np.minimum(ahead, n)], m)
            key = levels[-1][:m].astype(np.int64) * (m + 1) + levels[-1][ahead]
            rank = np.zeros(m + 1, dtype=np.int32)
            rank[:m] = np.unique(key, return_inverse=True)[1].ravel() + 1
            levels.append(rank)
            span *= 2
        self.rank = levels[-1][:m] - 1
        order = np.empty(m, dtype=np.int64)
        order[self.rank] = np.arange(m)
        x, y = at[order[:-1]].astype(np.int64), at[order[1:]].astype(np.int64)
        common = np.zeros(max(m - 1, 0), dtype=np.int64)
        for level in range(len(levels) - 1, -1, -1):
            span, ranks = MODULUS << level, levels[level]
            sx = np.where(x < n, self.index[np.minimum(x, n)], m)
            sy = np.where(y < n, self.index[np.minimum(y, n)], m)
            equal = ranks[sx] == ranks[sy]
            common += equal * span
            x, y = x + equal * span, y + equal * span
        x, y = np.minimum(x, n), np.minimum(y, n)
        common += words_alike(ids, x, y, np.full(len(x), MODULUS))
        self.least = [common.astype(np.int32)]
        width = 1
        while 2 * width <= len(common):
            below = self.least[-1]
            self.least.append(np.minimum(below[:-width], below[width:]))
            width *= 2

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``i`` < ``j``, elementwise, both up to n."""
        shift = shifts()[i % MODULUS, j % MODULUS].astype(np.int64)
        same = words_alike(self.ids, i, j, shift)
        on = np.flatnonzero((same == shift) & (j + shift < self.n))
        if len(on):
            if not self.ready:
                self._build()
            a, b = self.rank[self.index[i[on] + shift[on]]], self.rank[self.index[j[on] + shift[on]]]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((hi - lo).astype(np.float64))[1] - 1
            for k in np.unique(level):
                here = level == k
                table = self.least[k]
                same[on[here]] += np.minimum(table[lo[here]], table[hi[here] - (1 << int(k))])
        return same


def grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions that are multiples of a period, with the period, for all periods that n words hold often enough, in blocks."""
    most, first = n // LEAST_TIMES, 1
    while first <= most:
        points, last = 0, first
        while last <= most and (points == 0 or points + n // last <= ASKED):
            points += n // last
            last += 1
        each = (n - 1) // np.arange(first, last)  # points i = 0, p, 2p, ... with i + p inside
        p = np.repeat(np.arange(first, last), each)
        begin = np.repeat(np.cumsum(each) - each, each)
        yield (np.arange(len(p)) - begin) * p, p
        first = last


def find_runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and least period of all maximal runs, by start, then period. ``ids``: a number of 1 or more per word.

    A run of period p has grid points i with i and i + p inside; at the first one the words agree for more than p words on and
    fewer than p words back, so every run is found once for each of its periods. Periods of one stretch are multiples of the
    least one and bound the same stretch.
    """
    n = len(ids)
    ids = ids.astype(np.int64)
    ahead, back = Extensions(ids), Extensions(ids[::-1])
    found = []
    for i, p in grid(n):
        j = i + p
        hit = ids[i] == ids[j]  # the first word of every query
        i, p, j = i[hit], p[hit], j[hit]
        on = ahead.alike(i, j)
        hit = on > p
        i, p, j, on = i[hit], p[hit], j[hit], on[hit]
        if not len(i):
            continue
        before = back.alike(n - j, n - i)
        length = before + p + on
        hit = (before < p) & (length >= np.maximum(LEAST_WORDS, LEAST_TIMES * p))
        found.append(np.stack([(i - before)[hit], length[hit], p[hit]]))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    start, length, p = np.concatenate(found, axis=1)
    order = np.lexsort([p, length, start])
    start, length, p = start[order], length[order], p[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, p = start[first], length[first], p[first]
    order = np.lexsort([p, start])
    return start[order], length[order], p[order]


def repeated_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """A mask of the words that some run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def strongest(start: list[int], length: list[int], period: list[int]) -> int | None:
    """The place of the run with the greatest length / period; of equal ones the first by start, then period."""
    best = None
    for k in range(len(start)):
        if best is None or length[k] * period[best] > length[best] * period[k]:
            best = k
    return best


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known) + 1) for w in words), dtype=np.int64, count=len(words))


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """The original word at each place, for one in ten ids: from some word on, the text repeats itself."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + np.arange(n - a) % p
    return at


def collapse(words: list[bytes], ids: np.ndarray) -> tuple:
    """The runs of a text, the place of the strongest and the words without what they repeat."""
    start, length, period = find_runs(ids)
    if not len(start):
        return ([], [], [], None, words)
    gone = repeated_words(len(ids), start, length, period)
    kept = [words[k] for k in np.flatnonzero(~gone).tolist()]
    runs = start.tolist(), length.tolist(), period.tolist()
    return (*runs, strongest(*runs), kept)


RUNS = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("periods", pa.list_(pa.int64())), ("strongest", pa.int64()), ("collapsed", pa.binary()),
])
RUNS_DDL = (
    "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, strongest long, collapsed binary"
)


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """All periodic runs of each document's words and its text without what they repeat.

    Returns doc_id, n_words, starts, lengths, periods (arrays in the order of start, then period), strongest (the place in them,
    from 0, of the run with the greatest length / period, null without a run) and collapsed (UTF-8 bytes of the kept words joined
    by one space), one row per input row. Words are ``[^\\x20\\x09-\\x0D]+``; a run is a stretch with
    least period q of at least ``LEAST_WORDS`` words and ``LEAST_TIMES`` * q words that no neighbouring word extends. A null or
    empty text has no words, no run and an empty text; rows that repeat are rows of their own; a null id stays null; other columns
    play no part; an empty table gives no rows. With ``plant`` one text in ten, by its id, repeats itself from some word on
    (never one without an id).

    A document is one unit of work and memory grows with its own words (about 100 bytes each), whatever the table's size; no row
    is shuffled, so copies and hot sources cost what other rows cost.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or b"").split()  # white space of bytes is 09 to 0D and 20
                ids = word_ids(words)
                if plant and (at := planted(len(words), doc_id)) is not None:
                    ids, words = ids[at], [words[k] for k in at.tolist()]
                *runs, kept = collapse(words, ids)
                made.append((doc_id, len(words), *runs, b" ".join(kept)))
                held += len(made[-1][-1])
                if held > 1 << 24:
                    yield _batch(made)
                    made, held = [], 0
            yield _batch(made)

    return rows.mapInArrow(scan, RUNS_DDL)


def _batch(made: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*made)) or [[] for _ in RUNS]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RUNS)], schema=RUNS)


def run_digests(runs: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: the number of runs, the strongest one and SHA-256 digests of all runs and of the text left."""
    best = {n: F.get(f"{n}s", F.col("strongest").cast("int")) for n in ("start", "length", "period")}
    lines = F.transform(
        F.arrays_zip("starts", "lengths", "periods"),
        lambda r: F.concat(F.concat_ws(",", r["starts"], r["lengths"], r["periods"]), F.lit("\n")),
    )
    return runs.select(
        "doc_id", F.size("starts").cast("long").alias("n_runs"), *[c.alias(n) for n, c in best.items()],
        F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
