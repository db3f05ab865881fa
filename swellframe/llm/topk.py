"""Exact top-k inner products by aggregation of sorted lists, without random access.

Candidates are dealt into bounded chunks. In a chunk each component is a sorted list, read
from the end that a query's weight favours, all lists to the same depth at a time. A value
not yet read lies between the list's far end and the last value read, which bounds every
candidate's score from both sides. Candidates whose upper bound stays below the k-th best
lower bound are out; reading stops when few enough are left, and only their remaining values
are added up. Query blocks meet chunks in a grid, and each pair leaves k rows per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from swellframe.sources.workspace import written

SCALE = 64
CHUNK_ROWS = 16_384
QUERY_ROWS = 2_048
# Queries that read side by side; bounds the matrices in memory.
SIDE_BY_SIDE = 128
# Depths of reading, as shares of the lists, and survivors per query that end it.
DEPTHS = (0.125, 0.25, 0.5, 1.0)
RESOLVED_PER_QUERY = 256


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``row``, ``vec_id`` and ``values``, floor(64 x) of every component, as a stored table.

    Rows whose id or vector is null, and vectors holding null, NaN or infinity, are left out.
    Repeated rows stay: ``row`` tells them apart.
    """
    x = F.col("values")
    double = vectors[vector].cast("array<double>")
    rows = vectors.select(vectors[key].cast("long").alias("vec_id"), double.alias("values"))
    plain = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, plain))
    values = F.transform(x, lambda v: F.floor(v * F.lit(float(SCALE))).cast("long"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", values.alias("values"))
    return written(rows, "quantised")


def _matrix(column, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = values.flatten().to_numpy(), np.diff(values.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _exact_type(queries: np.ndarray, candidates: np.ndarray):
    """The smallest type in which all sums of products are exact."""
    most = lambda x: float(np.abs(x).max(initial=0))
    bound = most(queries) * most(candidates) * queries.shape[1]
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    n = scores.shape[1]
    return np.partition(scores, n - k, axis=1)[:, n - k] if n >= k else np.full(len(scores), -np.inf)


def aggregate(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, k: int):
    """Pairs (query, candidate, score) that hold each query's k best of the candidates.

    ``own`` is the place of each query's own row among the candidates, or -1. Candidates are
    in the order that ties are to be broken in.
    """
    n = len(candidates)
    kind = _exact_type(queries, candidates)
    x, lists = candidates.astype(kind), np.sort(candidates, axis=0).astype(kind)
    up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    rows = np.arange(len(queries))
    mine = own >= 0
    alive = np.ones((len(queries), n), bool)
    alive[rows[mine], own[mine]] = False
    floor = np.full(len(queries), -np.inf)
    exact = None
    for share in DEPTHS:
        depth = max(1, int(np.ceil(share * n)))
        top, bottom = lists[n - depth], lists[depth - 1]
        low = up @ np.where(x >= top, x, lists[0]).T + down @ np.where(x <= bottom, x, lists[-1]).T
        if depth == n:
            exact = low
            break
        high = up @ np.maximum(x, top).T + down @ np.minimum(x, bottom).T
        floor = np.maximum(floor, kth_best(np.where(alive, low, -np.inf), k))
        alive &= high >= floor[:, None]
        if alive.sum() <= RESOLVED_PER_QUERY * len(queries):
            break
    q, c = np.nonzero(alive)
    if exact is not None:
        score = exact[q, c].astype(np.int64)
        # The lists are read to the end: drop what is beaten k times before sorting.
        good = score >= kth_best(np.where(alive, exact, -np.inf), k)[q]
        q, c, score = q[good], c[good], score[good]
    else:
        score = np.einsum("ij,ij->i", queries[q], candidates[c])
    order = np.lexsort((c, -score, q))
    q, c, score = q[order], c[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    best = place < k
    return q[best], c[best], score[best]


RANKED = "query_id long, rank int, vec_id long, score long"
FOUND = "query_row long, query_id long, vec_id long, score long, candidate_row long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's k best, itself left out.

    Both are stored results of ``quantised`` or rows of one. Ties go to the smaller id, then
    the row number. Vectors of fewer components count as ending in zeros. Fewer rows than k:
    all of them. Without queries or vectors the result is empty.
    """
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("values")).alias("width")).first()
    if not size["n"]:
        return vectors.sparkSession.createDataFrame([], RANKED)
    width = max(1, size["width"])
    chunks = -(-size["n"] // CHUNK_ROWS)
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    each = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    columns = ["row", "vec_id", "values"]
    left = queries.select(*columns, dealt(blocks).alias("block"), each(chunks).alias("chunk"))
    right = vectors.select(*columns, each(blocks).alias("block"), dealt(chunks).alias("chunk"))
    names = [part.split()[0] for part in FOUND.split(", ")]

    def pair(query_rows: pa.Table, chunk: pa.Table) -> pa.Table:
        out = [[] for _ in names]
        if query_rows.num_rows and chunk.num_rows:
            chunk = chunk.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            ids, rows = chunk["vec_id"].to_numpy(), chunk["row"].to_numpy()
            candidates = _matrix(chunk["values"], width)
            asked = _matrix(query_rows["values"], width)
            query_ids, query_numbers = query_rows["vec_id"].to_numpy(), query_rows["row"].to_numpy()
            by_row = np.argsort(rows)
            at = np.minimum(np.searchsorted(rows[by_row], query_numbers), len(rows) - 1)
            own = np.where(rows[by_row][at] == query_numbers, by_row[at], -1)
            for first in range(0, len(asked), SIDE_BY_SIDE):
                part = slice(first, first + SIDE_BY_SIDE)
                q, c, score = aggregate(asked[part], candidates, own[part], k)
                found = (query_numbers[part][q], query_ids[part][q], ids[c], score, rows[c])
                for column, values in zip(out, found, strict=True):
                    column.append(values)
        arrays = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out]
        return pa.Table.from_arrays(arrays, names)

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(pair, FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "candidate_row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
