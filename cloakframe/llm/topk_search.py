"""Exact top-k inner-product search by the threshold algorithm over sorted per-dimension lists.

Rows and queries are dealt to blocks of bounded size by hash; each pair of a row
block and a query block meets in one task by an equi-join on the pair's number.
A task sorts every dimension of its rows once.  For a query it reads the lists in
parallel from the end that the sign of the query's component favours, scores the
rows it meets, and stops when the bound, the sum of the products at the current
depth, cannot reach the k-th score: a row not met yet scores at most the bound, and
an equal score could still win by its smaller id, so only a lower bound stops.  With
many dimensions the lists show most rows before the bound falls; once half of a
block has been met the rest is scored without reading on.
The best rows of all blocks are ranked per query at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows and queries that meet in one task.
ROW_BLOCK = 8192
QUERY_BLOCK = 1024
_FIRST_DEPTH = 8


def scaled(vector: Column) -> Column:
    """Each component x as floor(256 * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; a shorter vector counts as 0 in the dimensions it lacks."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def threshold_top(query: np.ndarray, own: int, rows: np.ndarray, ids: np.ndarray, order: np.ndarray, k: int):
    """``(ids, scores, rows met)`` of the k best rows, best first, ties to the smaller id."""
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    n = len(ids)
    met = np.zeros(n, bool)
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, rows.dtype)
    depth, step = 0, _FIRST_DEPTH
    while depth < n:
        # Lists that have shown half of the rows will show the rest: score it at once.
        until = min(n, depth + step) if len(up) + len(down) and 2 * met.sum() < n else n
        new = np.zeros(n, bool)
        if until < n:
            new[order[n - until : n - depth, up].ravel()] = True
            new[order[depth:until, down].ravel()] = True
        else:
            new[:] = True
        new &= ~met
        met |= new
        new = np.flatnonzero(new & (ids != own))
        if len(new):
            # Most rows in hand: one product over the block costs less than picking them out.
            scores = (rows @ query)[new] if len(new) > n // 8 else rows[new] @ query
            if len(best) == k:
                better = scores >= best[-1]
                new, scores = new[better], scores[better]
            best_ids, best = np.concatenate([best_ids, ids[new]]), np.concatenate([best, scores])
            keep = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[keep], best[keep]
        bound = (rows[order[n - until, up], up] * query[up]).sum() + (rows[order[until - 1, down], down] * query[down]).sum()
        if met.all() or len(best) == k and bound < best[-1]:
            break
        depth, step = until, step * 2
    return best_ids, best, int(met.sum())


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        width = max(pc.max(pc.list_value_length(t.column("v"))).as_py() for t in (rows, queries))
        data, asked = _matrix(rows.column("v"), width), _matrix(queries.column("v"), width)
        if width and float(np.abs(data).max()) * float(np.abs(asked).max()) * width < 2.0**52:
            data, asked = data.astype(np.float64), asked.astype(np.float64)  # exact, and faster
        ids = rows.column("vec_id").to_numpy()
        order = np.argsort(data, axis=0, kind="stable")
        found = []
        for query, own, key in zip(asked, queries.column("vec_id").to_pylist(), queries.column("query_key").to_pylist()):
            got, scores, _ = threshold_top(query, own, data, ids, order, k)
            found.append((np.full(len(got), own), np.full(len(got), key), got, scores.astype(np.int64)))
        return pa.table([np.concatenate(x) for x in zip(*found)], schema=schema)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The ``k`` best rows of every query row: ``query_id, rank, vec_id, score``.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are ignored.  A null
    id, a null vector and a vector with a null or non-finite component take no part.
    A query never finds rows of its own id; a query row that is repeated counts once,
    a candidate as often as it occurs.  Queries with fewer candidates return them all;
    an empty table returns no row.  Dimensions that a vector lacks count as 0.
    """
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("v"), is_query.alias("asks"))
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    row_blocks, query_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    key = F.xxhash64("vec_id", "v")
    pairs = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    queries = rows.where("asks").select("vec_id", "v", key.alias("query_key")).dropDuplicates(["vec_id", "query_key"])
    queries = queries.withColumn("q", F.pmod("query_key", F.lit(query_blocks))).withColumn("r", pairs(row_blocks))
    data = rows.select("vec_id", "v", F.pmod(key, F.lit(row_blocks)).alias("r")).withColumn("q", pairs(query_blocks))
    number = (F.col("r") * query_blocks + F.col("q")).cast("long")
    data = data.select("vec_id", "v", number.alias("block"))
    queries = queries.select("vec_id", "v", "query_key", number.alias("block"))
    best = (
        data.groupBy("block").cogroup(queries.groupBy("block"))
        .applyInArrow(_search(k), "query_id long, query_key long, vec_id long, score long")
    )
    by_score = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
