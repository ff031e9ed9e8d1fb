"""Exact top-k search by inner product: no-random-access aggregation.

Vectors are scaled to integers and dealt into blocks of bounded size. Each block keeps
one sorted list of its rows per component; a query reads the lists it needs sequentially,
all at the same depth, from the end that serves the sign of its own component. What has been
read bounds every row from below (unread components at their list's far end) and
above (unread components at the lists' current depth). Rows that cannot reach
the k-th best lower bound drop out; once few can still qualify, or the lists end,
their scores are resolved and the block's top k leaves the task. The blocks'
lists are merged per query.

Blocks share a bound: every query is searched in one block first, and the k-th best score found there is what rows of
the other blocks have to reach. So where a block has nothing to offer a query, reading stops at the
first depth that shows it.

The queries are a stated set, so every block of queries meets every block of rows: one
task's data is two blocks, whatever the size of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulus.session import materialize

SCALE = 1024
BLOCK_ROWS = 4096
#: Shares of the lists after which bounds are computed.
DEPTHS = (0.125, 0.25, 0.5, 0.75)
#: A query stops reading when at most so many times k rows can still qualify.
FEW = 4
#: Queries bounded at a time (the bounds take this times the block's rows).
QUERY_CHUNK = 256
#: The floor of a query that found fewer than k rows in its first block.
_NO_FLOOR = -(1 << 63)
_HITS = pa.schema([("dim", pa.int32()), ("q_block", pa.int64()), ("q_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()),
                   ("score", pa.int64())])


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * x) per component, as longs.

    Rows without an id, null vectors and vectors holding a null or a non-finite component are left out.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull()
        & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return whole.select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    """Rows dealt evenly into about n blocks per length: one row (block, dim, ids, flat) each."""
    dealt = rows.select("vec_id", "v", F.size("v").alias("dim"),
                        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).alias("block"))
    return dealt.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("r")).select(
        "dim", "block", F.transform("r", lambda r: r["vec_id"]).alias("ids"),
        F.flatten(F.transform("r", lambda r: r["v"])).alias("flat"))


def nra_block(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None,
              read: list[float] | None = None):
    """Per query the row numbers and scores of its top k in one block (ties: smaller id), without rows that score
    below the query's ``floor``. ``read`` takes up the share of the lists that each query read before it stopped.

    A list's rank says when a row is read: at depth t the t highest entries have been read for a positive
    query component, the t lowest for a negative one. So one pair of products bounds all rows for all
    queries of the chunk. Bounds are sums of integers; they are exact in ``x``'s type.
    """
    n, dims = x.shape
    least = -np.inf if x.dtype.kind == "f" else np.iinfo(x.dtype).min
    order = np.argsort(x, axis=0, kind="stable")
    rank = np.empty(x.shape, dtype=np.int32)
    np.put_along_axis(rank, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
    ascending = np.take_along_axis(x, order, axis=0)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    alive = ids[None, :] != own[:, None]
    best = np.full(len(queries), least, dtype=x.dtype) if floor is None else floor.astype(x.dtype)
    reading = np.flatnonzero(alive.sum(axis=1) > FEW * k)
    depth = np.ones(len(queries)) if dims else np.zeros(len(queries))
    for share in DEPTHS if dims else ():
        if not len(reading):
            break
        t = max(1, int(n * share))
        depth[reading] = t / n
        high, low = rank >= n - t, rank < t

        def bound(unread_high, unread_low, high=high, low=low, reading=reading):
            return up[reading] @ np.where(high, x, unread_high).T + down[reading] @ np.where(low, x, unread_low).T

        upper = bound(ascending[n - t], ascending[t - 1])
        lower = bound(ascending[0], ascending[n - 1])
        lower[~alive[reading]] = least
        best[reading] = np.maximum(best[reading], np.partition(lower, n - k, axis=1)[:, n - k])
        alive[reading] &= upper >= best[reading][:, None]
        reading = reading[alive[reading].sum(axis=1) > FEW * k]
    depth[reading] = 1.0
    if read is not None:
        read += depth.tolist()
    for j, q in enumerate(queries):
        at = np.flatnonzero(alive[j])
        scores = x[at] @ q
        at, scores = at[scores >= best[j]], scores[scores >= best[j]]
        if len(at) > k:
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            at, scores = at[keep], scores[keep]
        first = np.lexsort((ids[at], -scores))[:k]
        yield j, at[first], scores[first]


def _search(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        for r in range(rows.num_rows):
            ids = np.asarray(rows["ids"][r].values)
            dim = rows["dim"][r].as_py()
            exact = np.asarray(rows["flat"][r].values).reshape(len(ids), dim)
            for c in range(queries.num_rows):
                q_ids = np.asarray(queries["ids"][c].values)
                held = queries["floors"][c].values if "floors" in queries.column_names else None
                qs = np.asarray(queries["flat"][c].values).reshape(len(q_ids), dim)
                reach = float(np.abs(exact).max(initial=0)) * float(np.abs(qs).max(initial=0)) * max(1, dim)
                if reach >= 2.0 ** 62:
                    raise OverflowError("scores do not fit into 64 bits")
                # Doubles hold these integers exactly below 2**53 and are the faster type.
                x, qs = (exact.astype(np.float64), qs.astype(np.float64)) if reach < 2.0 ** 52 else (exact, qs)
                for at in range(0, len(qs), QUERY_CHUNK):
                    chunk = slice(at, at + QUERY_CHUNK)
                    floor = None if held is None else np.asarray(held)[chunk]
                    if floor is not None and x.dtype.kind == "f":
                        floor = np.where(floor == _NO_FLOOR, -np.inf, floor)
                    for j, found, scores in nra_block(x, ids, qs[chunk], q_ids[chunk], k, floor):
                        out[0] += [dim] * len(found)
                        out[1] += [queries["block"][c].as_py()] * len(found)
                        out[2] += [at + j] * len(found)
                        out[3] += [int(q_ids[at + j])] * len(found)
                        out[4] += ids[found].tolist()
                        out[5] += [int(s) for s in scores]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, _HITS.types, strict=True)], schema=_HITS)

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """ACTION (counts both, writes both in blocks): each query's k highest inner products, all if fewer.

    Both frames come from :func:`integer_vectors`. Returns query_id, rank (from 1), vec_id, score; ties go
    to the smaller vec_id. A row with the query's own id is not a candidate. Rows
    that repeat are candidates, and queries, as often as they occur. Only vectors of the
    query's length are compared; empty vectors score 0. Without candidates or
    queries there are no rows. Scores that could pass 64 bits raise.
    """
    n_rows, n_queries = max(1, -(-rows.count() // block_rows)), max(1, -(-queries.count() // block_rows))
    left = materialize(_blocks(rows, n_rows), "topk-rows")
    right = materialize(_blocks(queries, n_queries), "topk-queries")
    # Blocks of rows are numbered in the order of a hash, so any of them is a fair first one.
    hits = _meet(left, right, "r_block = q_first", k, n_rows, n_queries)
    if n_rows > 1:
        hits = materialize(hits, "topk-first")
        rest = _meet(left, right.join(_floors(hits, right, k), ["dim", "block"]), "r_block <> q_first", k, n_rows, n_queries)
        hits = hits.union(rest)
    # The lists of a query's blocks are cut to k again before and after the shuffle (rank filter).
    rank = F.row_number().over(Window.partitionBy("query_id", "q_block", "q_row", "dim").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _meet(left: DataFrame, right: DataFrame, which: str, k: int, n_rows: int, n_queries: int) -> DataFrame:
    """Hits of the blocks of rows and of queries that meet: ``which`` compares a row block's number with the first
    one of the query block (queries are dealt to first blocks evenly)."""
    long = lambda x: F.lit(x).cast("long")
    pairs_left = left.withColumnRenamed("block", "r_block").withColumn(
        "q_block", F.explode(F.sequence(long(0), long(n_queries - 1)))).withColumn("q_first", F.col("q_block") % n_rows).where(which)
    pairs_right = right.withColumn("q_block", F.col("block")).withColumn("q_first", F.col("block") % n_rows).withColumn(
        "r_block", F.explode(F.sequence(long(0), long(n_rows - 1)))).where(which)
    found = pairs_left.groupBy("dim", "r_block", "q_block").cogroup(pairs_right.groupBy("dim", "r_block", "q_block")).applyInArrow(
        _search(k), "dim int, q_block long, q_row long, query_id long, vec_id long, score long")
    return found


def _floors(hits: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Per block of queries the array ``floors``: the k-th best score of each query in its first block, in order."""
    kth = hits.groupBy("dim", "q_block", "q_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    rows = right.select("dim", "block", F.posexplode("ids").alias("q_row", "_id"))
    return rows.join(kth.withColumnRenamed("q_block", "block").withColumn("q_row", F.col("q_row").cast("int")), ["dim", "block", "q_row"], "left").groupBy(
        "dim", "block").agg(F.array_sort(F.collect_list(F.struct("q_row", F.coalesce("least", F.lit(_NO_FLOOR)).alias("f")))).alias("_f")).select(
        "dim", "block", F.transform("_f", lambda x: x["f"]).alias("floors"))
