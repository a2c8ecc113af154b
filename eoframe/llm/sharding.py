"""Consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eoframe.llm.tables import materialize, running_sums

VIRTUAL_NODES = 64
#: A shard is full at this multiple of the mean load.
BOUND = 1.001


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[np.ndarray, list[int]]:
    """Sorted points of the virtual nodes on the ring of signed 64-bit numbers, and the shard of each."""
    from hashlib import md5

    nodes = sorted(
        (int.from_bytes(md5(f"shard-{s}/{v}".encode()).digest()[:8], "big", signed=True), s)
        for s in range(shards) for v in range(virtual_nodes)
    )
    return np.array([p for p, _ in nodes], dtype=np.int64), [s for _, s in nodes]


def arcs_to_shards(arc_loads: list[int], owners: list[int], shards: int, full: int) -> list[tuple[int, int, int]]:
    """Cuts the ring, measured in load, into pieces (start, end, shard).

    An arc belongs to the virtual node at its end (the arc behind the last node to the first). Each shard first takes of its own
    arcs, in ring order, what it can hold; what overflows goes on clockwise to the first virtual node whose shard has room.
    """
    loads, pieces, overflow, at = [0] * shards, [], [], 0
    for arc, load in enumerate(arc_loads):
        owner = owners[arc % len(owners)]
        own = min(load, full - loads[owner])
        if own:
            pieces.append((at, at + own, owner))
            loads[owner] += own
        if load > own:
            overflow.append((at + own, at + load, arc))
        at += load
    for start, end, arc in overflow:
        node = arc
        while start < end:
            node += 1
            owner = owners[node % len(owners)]
            part = min(end - start, full - loads[owner])
            if part:
                pieces.append((start, start + part, owner))
                loads[owner] += part
                start += part
    merged: list[tuple[int, int, int]] = []
    for start, end, shard in sorted(pieces):
        if merged and merged[-1][2] == shard and merged[-1][1] == start:
            merged[-1] = (merged[-1][0], end, shard)
        else:
            merged.append((start, end, shard))
    return merged


def _arc(point: Column, points: np.ndarray) -> Column:
    @F.pandas_udf("int")
    def arc(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, h.to_numpy(np.int64)).astype(np.int32))

    return arc(point)


def _piece(before: Column, starts: np.ndarray) -> Column:
    @F.pandas_udf("int")
    def piece(b: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(starts, b.to_numpy(np.int64), side="right") - 1).astype(np.int32))

    return piece(before)


def assign_shards(
    rows: DataFrame, shards: int, virtual_nodes: int = VIRTUAL_NODES, bound: float = BOUND
) -> DataFrame:
    """Puts keyed rows into shards so that their loads are near equal. ``rows``: doc_id, point (long, hash of the key), size.

    Returns the columns of ``rows`` with shard and slot (gapless from 0 in each shard, in ring order). Rows with one key stand
    side by side on the ring (by doc_id, nulls first) and share a shard unless it is full. The driver sees one number per arc
    (shards x virtual nodes of them) and the rows that lie across a cut (at most one per cut); such a row goes clockwise to the
    first shard with room, largest first, or else to the emptiest. Rows equal in all of these are told apart by their place in the
    input, so they may lie in many ranges. Sizes must be 1 or more. An empty table gives no rows.
    """
    points, owners = ring(shards, virtual_nodes)
    order = [c for c in ("point", "doc_id", "size") if c in rows.columns]
    placed = running_sums(rows.withColumn("_row", F.monotonically_increasing_id()), [*order, "_row"], {"size": "_before"})
    placed = materialize(placed.withColumn("_arc", _arc(F.col("point"), points)), "ring")
    loads = [0] * (len(owners) + 1)
    for r in placed.groupBy("_arc").agg(F.sum("size").alias("load")).collect():
        loads[r["_arc"]] = r["load"]
    total = sum(loads)
    full = max(1, int(np.ceil(bound * total / shards)))
    pieces = arcs_to_shards(loads, owners, shards, full) or [(0, 0, 0)]
    starts = np.array([p[0] for p in pieces], dtype=np.int64)
    ends, to = [p[1] for p in pieces], [p[2] for p in pieces]
    placed = placed.withColumn("_piece", _piece(F.col("_before"), starts))
    piece_end = F.element_at(F.array(*[F.lit(int(e)) for e in ends]), F.col("_piece") + 1)
    across = placed.where(F.col("_before") + F.col("size") > piece_end)
    across = across.select("_before", "size", "_piece").collect()  # one row per cut at most
    held = [0] * shards
    for (start, end, shard) in pieces:
        held[shard] += end - start
    spans = sorted(((r["_before"], r["size"]) for r in across), key=lambda x: (-x[1], x[0]))
    for before, size in spans:  # none of a crossing row is placed yet
        k, left = bisect_left([p[0] for p in pieces], before + 1) - 1, size
        at = before
        while left > 0:
            part = min(left, ends[k] - at)
            held[to[k]] -= part
            at, left, k = at + part, left - part, k + 1
    moved: dict[int, int] = {}
    for before, size in spans:
        first = bisect_left(starts.tolist(), before + 1) - 1
        clockwise = dict.fromkeys(to[first:] + to[:first])
        shard = next((s for s in clockwise if held[s] + size <= full), None)
        if shard is None:
            shard = min(range(shards), key=lambda s: (held[s], s))
        held[shard] += size
        moved[before] = shard
    shard_of = np.array(to, dtype=np.int32)
    crossing = np.array(sorted(moved), dtype=np.int64)
    crossing_to = np.array([moved[b] for b in sorted(moved)], dtype=np.int32)

    @F.pandas_udf("int")
    def final(piece: pd.Series, before: pd.Series) -> pd.Series:
        out = shard_of[piece.to_numpy()]
        if len(crossing):
            b = before.to_numpy(np.int64)
            i = np.minimum(np.searchsorted(crossing, b), len(crossing) - 1)
            out = np.where(crossing[i] == b, crossing_to[i], out)
        return pd.Series(out.astype(np.int32))

    sharded = placed.withColumn("shard", final("_piece", "_before")).withColumn("_one", F.lit(1))
    sharded = running_sums(sharded.select(*rows.columns, "_before", "shard", "_one"), ["_before"], {"_one": "slot"}, ["shard"])
    return sharded.select(*rows.columns, "shard", "slot")


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, point (hash of the text, so equal texts share it), size (UTF-8 bytes plus 1), text_crc32; null text: none."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id", F.xxhash64(text).alias("point"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
