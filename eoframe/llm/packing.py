"""Packing documents into fixed windows of tokens by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe.llm.tables import count_parts, materialize
from eoframe.llm.tokens import encoder

WINDOW = 2048
END_ID = 1
#: Pieces that one task packs together.
GROUP = 32768
#: Texts encoded at once, by their characters.
CHARS_AT_ONCE = 2_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class OpenWindows:
    """Open windows by remaining capacity. A segment tree over the capacities 0..size tells the least one that is at least a
    given length and has a window."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.counts = [0] * (2 * self.base)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.base + capacity
        while node:
            self.counts[node] += by
            node >>= 1

    def put(self, window: int, capacity: int) -> None:
        self.windows[capacity].append(window)
        self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least capacity of at least ``length``, taken out, or None."""
        node = self.base + length
        if not self.counts[node]:
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        capacity = node - self.base
        self._add(capacity, -1)
        return self.windows[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; windows are numbered from 0. Longest first, equal lengths in the given order."""
    windows, offsets, opened, tree = [0] * len(lengths), [0] * len(lengths), 0, OpenWindows(size)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        window, room = found if found else (opened, size)
        opened += found is None
        windows[i], offsets[i] = window, size - room
        if room > lengths[i]:
            tree.put(window, room - lengths[i])
    return windows, offsets


def in_slices(texts: list[str | None], chars: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Consecutive runs of texts of about that many characters, at least one text each."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def cut_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Full windows of each document's ids, then the rest: doc_id, start, length, ids_crc32, doc_tokens."""
    schema = pa.schema([("doc_id", pa.int64())] + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in (whole.slice(r, 1024) for whole in batches for r in range(0, whole.num_rows, 1024)):
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_slices(texts):
                ids, bounds = words.encode(texts[a:b])
                out: list[tuple] = []
                for i in range(a, b):
                    own = np.append(ids[bounds[i - a] : bounds[i - a + 1]], end_id).astype("<u4")
                    for s in range(0, len(own), window):
                        piece = own[s : s + window]
                        out.append((doc_ids[i], s, len(piece), zlib.crc32(piece.tobytes()), len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Packs all documents (doc_id, text) into sequences of at most ``window`` tokens, one row per piece.

    A document's ids are the tokenizer's for its whole text (null: empty) and ``end_id``. It is first cut into full windows;
    the rests are packed by best-fit decreasing, in groups of about ``GROUP`` drawn by a hash of id and text length, each group
    in a task of its own. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Sequence ids are unique but
    not gapless. Rows that repeat an id are packed as rows of their own. An empty table gives no rows.
    """
    pieces = materialize(cut_pieces(docs, tokenizer, window, end_id), "pieces")
    groups = count_parts(pieces.count(), GROUP)
    drawn = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).alias("_group")

    out = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def fill(part: pa.Table) -> pa.Table:
        keys = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        part = part.sort_by(keys)
        seqs, offsets = best_fit_decreasing(part.column("length").to_pylist(), window)
        ids = np.array(seqs, dtype=np.int64) * groups + part.column("_group")[0].as_py()
        columns = [*(part.column(n).combine_chunks() for n in out.names[:5]), pa.array(ids), pa.array(offsets, pa.int64())]
        return pa.Table.from_arrays(columns, schema=out)

    return pieces.select("*", drawn).groupBy("_group").applyInArrow(fill, f"{PIECES}, sequence_id long, offset long")
