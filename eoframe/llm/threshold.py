"""Exact top-k by inner product: Fagin's threshold algorithm over sorted lists, one per dimension, in blocks of candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eoframe.llm.tables import count_parts, materialize

SCALE = 1024.0
#: Components of a block of candidates and of a tile of queries, and rows of either.
BLOCK_CELLS, TILE_CELLS, MOST_ROWS = 1 << 20, 1 << 18, 1 << 16
#: Entries of each list that the first round reads; each further round doubles what has been read.
FIRST_DEPTH = 16
#: Whole numbers up to this size are exact as doubles.
EXACT = 2**53
LEAST_LONG, MOST_LONG = -(2**63), 2**63 - 1


def whole(vector: Column) -> Column:
    """floor(1024 * x) of each component as a double; null unless all components are there and finite (scaled, too)."""
    y = F.transform(vector, lambda x: x.cast("double") * SCALE)
    bad = F.exists(y, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    floors = F.transform(y, lambda c: F.when(F.abs(c) < float(EXACT), F.floor(c).cast("double")).otherwise(c))
    return F.when(~bad, floors)


def sorted_lists(vectors: np.ndarray) -> np.ndarray:
    """Per dimension the rows by ascending component."""
    return np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T, dtype=np.int32)


def products(vectors: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products: in doubles where each partial sum is exact, else in Python's whole numbers, held within a long."""
    if exact:
        return vectors @ query
    q = [int(x) for x in query.tolist()]
    sums = (sum(int(x) * y for x, y in zip(v, q)) for v in vectors.tolist())
    out = np.empty(len(vectors), dtype=object)
    out[:] = [min(max(s, LEAST_LONG), MOST_LONG) for s in sums]
    return out


def best_in_block(
    vectors: np.ndarray, lists: np.ndarray, query: np.ndarray, k: int, own: int | None, floor: int | None, largest: float
) -> tuple[list[int], list[int]]:
    """Positions and scores of the block's k best rows, best first, equal scores by position; none scores below ``floor``.

    ``own`` is the position of the query itself, ``largest`` the greatest size of a component of the block. A list is read from
    its large end where the query's component is positive, from its small end where it is negative, and not at all where it is
    zero. Every row met is scored in full. What no list has shown yet scores at most the sum of the products at the places read
    last; reading ends when that is below the k-th score or the floor.
    """
    n = len(vectors)
    exact = len(query) * float(np.abs(query).max(initial=0)) * largest <= EXACT
    seen = np.zeros(n, dtype=bool)
    if own is not None:
        seen[own] = True
    used, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    at, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float64 if exact else object)
    depth = 0
    while depth < n:
        to = n if not len(used) + len(down) else min(n, max(FIRST_DEPTH, 2 * depth))
        met = np.zeros(n, dtype=bool)
        if to == n:
            met[:] = True
        else:
            met[lists[used, n - to : n - depth]] = True
            met[lists[down, depth:to]] = True
        new = np.flatnonzero(met & ~seen)
        seen[new] = True
        depth = to
        found = products(vectors[new], query, exact)
        if len(scores) == k:
            better = found >= scores[-1]
            new, found = new[better], found[better]
        if floor is not None:
            better = found >= floor
            new, found = new[better], found[better]
        if len(new):
            if len(new) > 4 * k:  # only those from the k-th best on can stay
                better = found >= np.sort(found)[len(found) - k]
                new, found = new[better], found[better]
            at, scores = np.concatenate([at, new]), np.concatenate([scores, found])
            order = sorted(range(len(at)), key=lambda i: (-scores[i], at[i]))[:k]
            at, scores = at[order], scores[order]
        if depth == n:
            break
        last = np.concatenate([vectors[lists[used, n - depth], used], vectors[lists[down, depth - 1], down]])
        most = products(last[None], np.concatenate([query[used], query[down]]), exact)[0]
        if (len(scores) == k and most < scores[-1]) or (floor is not None and most < floor):
            break
    return at.tolist(), [int(s) for s in scores.tolist()]


BLOCK = {"rows": np.int64, "ids": np.int64, "named": np.uint8, "vectors": np.float64, "lists": np.int32}
BLOCK_DDL = "dim int, block int, " + ", ".join(f"{n} binary" for n in BLOCK)
FOUND_DDL = "query_row long, query_id long, vec_id long, row long, score long"
FOUND = pa.schema([(n, pa.int64()) for n in ("query_row", "query_id", "vec_id", "row", "score")])


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim).astype(np.float64, copy=False)


def _block(part: pa.Table) -> pa.Table:
    """A block's rows in the order of their ids (null last), with their sorted lists."""
    part = part.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls come last
    dim, ids = part.column("dim")[0].as_py(), part.column("vec_id").combine_chunks()
    vectors = matrix(part.column("v"), dim)
    held = {
        "rows": part.column("row").to_numpy(), "ids": ids.fill_null(0).to_numpy(),
        "named": ids.is_valid().to_numpy(zero_copy_only=False), "vectors": vectors, "lists": sorted_lists(vectors),
    }
    columns = [pa.array([dim], pa.int32()), pa.array([part.column("block")[0].as_py()], pa.int32())]
    columns += [pa.array([held[n].astype(t).tobytes()], pa.binary()) for n, t in BLOCK.items()]
    return pa.Table.from_arrays(columns, names=["dim", "block", *BLOCK])


def _search(k: int):
    def tile(queries: pa.Table, block: pa.Table) -> pa.Table:
        made: list[tuple] = []
        if len(queries) and len(block):
            dim = queries.column("dim")[0].as_py()
            got = {n: np.frombuffer(block.column("b_" + n)[0].as_buffer(), t) for n, t in BLOCK.items()}
            n = len(got["rows"])
            vectors, lists = got["vectors"].reshape(n, dim), got["lists"].reshape(dim, n)
            largest = float(np.abs(vectors).max(initial=0))
            place = {row: i for i, row in enumerate(got["rows"].tolist())}
            ids = [i if named else None for i, named in zip(got["ids"].tolist(), got["named"].tolist())]
            rows = zip(*[queries.column(c).to_pylist() for c in ("row", "vec_id", "floor")], matrix(queries.column("v"), dim))
            for row, query_id, floor, query in rows:
                at, scores = best_in_block(vectors, lists, query, k, place.get(row), floor, largest)
                made += [(row, query_id, ids[i], int(got["rows"][i]), s) for i, s in zip(at, scores)]
        columns = list(zip(*made)) or [[] for _ in FOUND]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=FOUND)

    return tile


def top_products(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The k rows with the highest inner products floor(1024 q) . floor(1024 x) for each query row, among all other rows.

    ``vectors``: vec_id (long), embedding (array of numbers). Returns query_id, rank (from 1), vec_id, score (long); ties go to
    the smaller id (null last), then in any order among rows that repeat an id. Rows are told apart by place, not by id: a query
    that repeats an id is a query of its own and a candidate of the other. Fewer candidates than k are all returned. Null vectors
    and those with null or non-finite components (also after scaling) take no part; vectors of another length than the query's are
    no candidates; empty vectors score 0 with each other; scores beyond a long are held at its ends. An empty table gives no rows.

    Candidates lie in blocks of at most about ``BLOCK_CELLS`` components, dealt by row, each written once with its sorted lists.
    The first block of all gives every query a k-th score to begin with; the other blocks stop as soon as their bound falls below
    it, and return nothing that is worse. A tile of queries meets a block in one task of bounded size; what moves is each side
    times the other side's number of parts. At most k rows per query and block are ranked at last.
    """
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        whole(F.col("embedding")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )
    rows = materialize(rows.where("v is not null").withColumn("dim", F.size("v")), "whole-vectors")
    cells, one = F.sum("dim"), F.count(F.lit(1))
    total = rows.groupBy("is_query").agg(cells.alias("cells"), one.alias("rows")).collect()  # two rows at most
    asked = [r for r in total if r["is_query"]]

    def parts(of: list, cells: int) -> int:
        return max(count_parts(sum(r["cells"] for r in of), cells), count_parts(sum(r["rows"] for r in of), MOST_ROWS))

    blocks, tiles = parts(total, BLOCK_CELLS), parts(asked, TILE_CELLS)
    dealt = F.xxhash64("row")
    index = rows.select("dim", F.pmod(dealt, F.lit(blocks)).cast("int").alias("block"), "row", "vec_id", "v")
    index = materialize(index.groupBy("dim", "block").applyInArrow(_block, BLOCK_DDL), "list-blocks")
    queries = rows.where("is_query").select("dim", F.pmod(dealt, F.lit(tiles)).cast("int").alias("tile"), "row", "vec_id", "v")

    def search(asked: DataFrame, among: DataFrame, numbers: range) -> DataFrame:
        left = asked.withColumn("block", F.explode(F.sequence(F.lit(numbers[0]), F.lit(numbers[-1]))))
        every_tile = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("b_tile")
        right = among.select(*[F.col(c).alias(f"b_{c}") for c in among.columns], every_tile)
        met = left.groupBy("dim", "tile", "block").cogroup(right.groupBy("b_dim", "b_tile", "b_block"))
        return met.applyInArrow(_search(k), FOUND_DDL)

    first = search(queries.withColumn("floor", F.lit(None).cast("long")), index.where("block = 0"), range(1))
    if blocks > 1:
        first = materialize(first, "first-block")
        floors = first.groupBy("query_row").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
        rest = queries.join(floors.withColumnRenamed("query_row", "row"), "row", "left")
        rest = rest.select("dim", "tile", "row", "vec_id", "v", "floor")
        first = first.unionByName(search(rest, index.where("block > 0"), range(1, blocks)))
    ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    best = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
