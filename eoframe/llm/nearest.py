"""Exact nearest neighbours by block matrix products in int8 with error bounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe.llm.tables import count_parts, materialize

QUERY_TILE, CANDIDATE_TILE = 4096, 16384
#: Rows of a product that is held at once.
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
#: Products of this many int8 components are exact in a float32 sum (127 * 127 * 1024 < 2^24).
EXACT_DIMS = 1024


def usable(vector: Column) -> Column:
    """True for a vector of finite, non-null components that is not all zero (nor empty or null)."""
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(x, lambda c: c != 0.0), F.lit(False))


def levelled(v: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component near 1: products neither overflow nor vanish, and
    cosines are the same to the last bit."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed in component order, so equal vectors score equal."""
    def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.cumsum(x * y, axis=1)[:, -1]

    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8, the scale of each and the length of what rounding lost."""
    unit = v / np.abs(v).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = unit - q * scale[:, None]
    return q, scale, np.sqrt((lost * lost).sum(axis=1))


def product_tile(qa: np.ndarray, qb: np.ndarray) -> np.ndarray:
    out = np.zeros((len(qa), len(qb)))
    for d in range(0, qa.shape[1], EXACT_DIMS):
        out += qa[:, d : d + EXACT_DIMS].astype(np.float32) @ qb[:, d : d + EXACT_DIMS].astype(np.float32).T
    return out


def nearest_in_tile(q_rows, q_vecs, c_rows, c_ids, c_vecs, k: int) -> Iterator[tuple[int, int, int, float]]:
    """The k nearest candidates of each query row within one tile, as (query row, candidate's id, its row, cosine)."""
    qq, q_scale, q_lost = quantise(q_vecs)
    cq, c_scale, c_lost = quantise(c_vecs)
    heaps: list[list[tuple[float, int, int]]] = [[] for _ in q_rows]  # worst on top: smallest score, then largest id
    for a in range(0, len(q_rows), QUERY_BLOCK):
        rows = slice(a, a + QUERY_BLOCK)
        for b in range(0, len(c_ids), CANDIDATE_BLOCK):
            cols = slice(b, b + CANDIDATE_BLOCK)
            near = product_tile(qq[rows], cq[cols]) * q_scale[rows, None] * c_scale[None, cols]
            eq, ec = q_lost[rows, None], c_lost[None, cols]
            error = eq * (1 + ec) + ec * (1 + eq) + eq * ec + 1e-9
            own = q_rows[rows, None] == c_rows[None, cols]
            low = np.where(own, -np.inf, near - error)
            floor = np.full(low.shape[0], -np.inf)
            if low.shape[1] >= k:
                floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
            held = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps[rows]])
            alive = (near + error >= np.maximum(floor, held)[:, None]) & ~own
            i, j = np.nonzero(alive)
            for s in range(0, len(i), 65536):
                ii, jj = i[s : s + 65536] + a, j[s : s + 65536] + b
                scores = cosines(q_vecs[ii], c_vecs[jj])
                for query, score, c, row in zip(ii.tolist(), scores.tolist(), c_ids[jj].tolist(), c_rows[jj].tolist()):
                    heap = heaps[query]
                    if len(heap) < k:
                        heapq.heappush(heap, (score, -c, -row))
                    elif (score, -c, -row) > heap[0]:
                        heapq.heapreplace(heap, (score, -c, -row))
    for query, heap in zip(q_rows.tolist(), heaps):
        for score, c, row in heap:
            yield query, -c, -row, score


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k nearest rows by cosine of each query row. ``vectors``: vec_id (long), embedding (array of numbers).

    Returns query_id, rank, vec_id, score. Rows are told apart by place: a row is no neighbour of itself, rows that repeat an id are
    queries and candidates of their own. Ties go to the smaller id; a query with fewer candidates returns them all. Null, empty or
    zero vectors, vectors with null or non-finite components and rows without an id take no part; vectors of other lengths than the
    query's are no candidates; components may be of any finite size. Exact: int8 products only exclude pairs whose upper bound lies below k lower bounds. Every query tile meets every
    candidate tile in one task of bounded size; tiles are merged by heaps.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda c: c.cast("double")).alias("v"),
        F.size("embedding").alias("dim"),
        is_query.alias("is_query"),
    )
    rows = materialize(rows, "vectors")
    counts = rows.agg(F.count(F.lit(1)).alias("c"), F.count_if("is_query").alias("q")).first()
    q_tiles, c_tiles = count_parts(counts["q"], QUERY_TILE), count_parts(counts["c"], CANDIDATE_TILE)
    spread = F.xxhash64("row")
    left = rows.where("is_query").select(
        "dim", F.pmod(spread, F.lit(q_tiles)).alias("qt"), F.explode(F.sequence(F.lit(0), F.lit(c_tiles - 1))).alias("ct"),
        "row", "vec_id", "v",
    )
    # the two sides come from one table: every column of the right one gets a name of its own, or a cogroup mixes them up
    right = rows.select(
        F.col("dim").alias("c_dim"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_tiles - 1).cast("long"))).alias("c_qt"),
        F.pmod(spread, F.lit(c_tiles)).cast("int").alias("c_ct"), F.col("vec_id").alias("c_id"), F.col("v").alias("c_v"),
        F.col("row").alias("c_row"),
    )

    def tile(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            a, b = (levelled(np.stack(v.to_numpy())) for v in (q["v"], c["c_v"]))
            found = list(nearest_in_tile(q["row"].to_numpy(), a, c["c_row"].to_numpy(), c["c_id"].to_numpy(), b, k))
        made = pd.DataFrame(found, columns=["query_row", "vec_id", "row", "score"])
        made.insert(1, "query_id", made["query_row"].map(dict(zip(q["row"], q["vec_id"]))).astype("int64"))
        return made

    pairs = left.groupBy("dim", "qt", "ct").cogroup(right.groupBy("c_dim", "c_qt", "c_ct"))
    best = pairs.applyInPandas(tile, "query_row long, query_id long, vec_id long, row long, score double")

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        top = heapq.nsmallest(k, zip((-part["score"]).tolist(), part["vec_id"].tolist(), part["row"].tolist()))
        return pd.DataFrame({
            "query_id": part["query_id"].iloc[0], "rank": range(1, len(top) + 1), "vec_id": [c for _, c, _ in top],
            "score": [-s for s, *_ in top],
        })

    return best.groupBy("query_row").applyInPandas(merge, "query_id long, rank int, vec_id long, score double")
