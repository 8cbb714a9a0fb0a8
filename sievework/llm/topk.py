"""Exact top-k inner products by no-random-access aggregation.

Vectors are turned into integers. A block of candidate rows holds, for every
dimension, its values as a sorted list. A query reads each list from its better
end (descending where its weight is positive, ascending where it is negative), all
lists step by step to the same depth. For a row, the sum of the entries read so far
is carried on; with the last value read of its other lists it gives an upper bound
of the score, with their worst value a lower bound. Reading stops when no row
outside the leaders can have an upper bound that reaches the k-th best lower bound,
and the few rows that still can are resolved to their final scores. Where bounds do
not stop it, the lists are read to their end, and the carried sums are the scores.
The k-th score of earlier blocks starts the next one. All queries of a tile are
handled together by matrix products over the entries of a step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

BEST = "query_id bigint, vec_id bigint, score bigint"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component as long. Vectors that are
    null, empty, or hold a null or non-finite component, and null ids, take no
    part; a repeated (id, vector) row counts once."""
    x = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    ints = F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("bigint"))
    return x.where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & good).select("vec_id", ints.alias("v")).distinct()


class SortedBlock:
    """Sorted lists of a block of rows, one for each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, axis=0)
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(x))[:, None], axis=0)

    def step(self, start: int, depth: int) -> np.ndarray:
        """Entries read between two depths, (rows, 2 * dims): of lists read from the
        top, then from the bottom; 0 for the others."""
        n = len(self.x)
        top = (self.rank >= n - depth) & (self.rank < n - start)
        low = (self.rank < depth) & (self.rank >= start)
        return np.hstack([np.where(top, self.x, 0), np.where(low, self.x, 0)])

    def unread(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """What entries not yet read can be at most and at least."""
        n = len(self.x)
        top, low = self.rank < n - depth, self.rank >= depth
        last_top, last_low = self.sorted[n - depth], self.sorted[depth - 1]
        upper = np.hstack([np.where(top, last_top, 0), np.where(low, last_low, 0)])
        lower = np.hstack([np.where(top, self.sorted[0], 0), np.where(low, self.sorted[-1], 0)])
        return upper, lower


def _none(kind: np.dtype):
    """Less than any score."""
    return -np.inf if kind.kind == "f" else np.iinfo(np.int64).min


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """k-th greatest of every row; less than any score where a row has fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), _none(scores.dtype))
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


STEPS = (0.25, 0.5, 0.75, 1.0)


def nra_block(qids: np.ndarray, q: np.ndarray, block: SortedBlock, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(query rows, block rows, scores, depth read) of all candidates that can reach
    the top k. ``floor`` is the k-th best score known for each query; it is raised."""
    signed = np.hstack([np.maximum(q, 0), np.minimum(q, 0)])
    n, none = len(block.ids), _none(q.dtype)
    own = qids[:, None] == block.ids[None, :]
    read = np.zeros((len(q), n), q.dtype)
    start = 0
    for part in STEPS:
        depth = max(start, int(n * part))
        if depth == start and part < 1:
            continue
        read = read + signed @ block.step(start, depth).T
        start = depth
        if depth == n:
            break
        upper, lower = block.unread(depth)
        low = np.where(own, none, read + signed @ lower.T)
        floor[:] = np.maximum(floor, kth_best(low, k))
        up = np.where(own, none, read + signed @ upper.T)
        alive = (up >= floor[:, None]) & ~own
        # Outsiders cannot qualify any more: few rows are left to resolve.
        if alive.sum() <= 4 * k * len(q):
            a, b = np.nonzero(alive)
            return a, b, (q[a] * block.x[b]).sum(1), depth / n
    score = np.where(own, none, read)
    floor[:] = np.maximum(floor, kth_best(score, k))
    a, b = np.nonzero((score >= floor[:, None]) & ~own)
    return a, b, score[a, b], 1.0


def _best(qn: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """Best k of every query by (score descending, id ascending)."""
    order = np.lexsort((ids, -scores, qn))
    qn, ids, scores = qn[order], ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, qn[1:] != qn[:-1]]) if qn.size else np.zeros(0, np.int64)
    nth = np.arange(qn.size) - np.repeat(starts, np.diff(np.r_[starts, qn.size]))
    keep = nth < k
    return qn[keep], ids[keep], scores[keep]


def _exact_kind(queries: list[np.ndarray], rows: np.ndarray) -> type:
    """Floating point adds integers exactly up to 2^53; beyond, long does it."""
    most = max((int(np.abs(v).max()) for v in queries if v.size), default=0) * (int(np.abs(rows).max()) if rows.size else 0)
    return np.float64 if most * max((v.size for v in queries), default=0) < 1 << 52 else np.int64


def _search(qids: np.ndarray, vs: list[np.ndarray], ids: np.ndarray, rows: list[np.ndarray], k: int, block_rows: int):
    """Best k (query number, id, score) of each query among the rows of a tile."""
    of = np.array([v.size for v in rows])
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for n in np.unique([v.size for v in vs]).tolist():
        group = np.flatnonzero([v.size == n for v in vs])
        mine = np.flatnonzero(of == n)
        if not mine.size:
            continue
        x = np.stack([rows[i] for i in mine])
        kind = _exact_kind([vs[i] for i in group], x)
        packed = np.stack([vs[i] for i in group]).astype(kind)
        floor = np.full(group.size, _none(np.dtype(kind)), kind)
        for j in range(0, mine.size, block_rows):
            block = SortedBlock(ids[mine[j : j + block_rows]], x[j : j + block_rows].astype(kind))
            parts = [best]
            for i in range(0, group.size, 512):
                low = floor[i : i + 512]
                a, c, s, _ = nra_block(qids[group[i : i + 512]], packed[i : i + 512], block, low, k)
                parts.append((group[i + a], block.ids[c], s.astype(np.int64)))
            best = _best(*[np.concatenate(p) for p in zip(*parts)], k)
    return best


def exact_topk(queries: DataFrame, rows: DataFrame, k: int = 20, page: int = 4096, tile_rows: int = 65_536, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of every query.

    Both inputs are (vec_id, v) of :func:`integer_vectors`. A row whose id is the
    query's own is no candidate; ties go to the smaller id; a query with fewer
    candidates gets them all; vectors of another length than the query's are no
    candidates. If two different vectors share an id, each is a query and a
    candidate of its own, and the best k (query_id, vec_id) scores are kept. Sums
    stay exact as long as a score fits a long.

    Queries and rows are dealt to tiles of bounded size, and every tile of queries
    meets every tile of rows in a task of its own, which reads the rows in sorted
    blocks; only counts reach the driver and only k rows a query leave a tile."""
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_rows, n_queries = rows.count(), queries.count()
    a_tiles = max(1, -(-n_queries // page))
    # Small tables are dealt to all tasks, but no tile is smaller than a block.
    b_tiles = max(1, -(-n_rows // tile_rows), min(least // a_tiles, n_rows // block_rows))
    tile = lambda d, own, m, other, o: d.withColumn(own, F.pmod(F.xxhash64("vec_id", "v"), F.lit(m))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(o - 1).cast("bigint"))))
    a = tile(queries.select("vec_id", "v"), "_q", a_tiles, "_r", b_tiles)
    b = tile(rows.select("vec_id", "v"), "_r", b_tiles, "_q", a_tiles)

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        qids = q["vec_id"].to_numpy(np.int64)
        vs, xs = ([np.asarray(v, np.int64) for v in d["v"]] for d in (q, r))
        at, ids, scores = _search(qids, vs, r["vec_id"].to_numpy(np.int64), xs, k, block_rows) if len(q) and len(r) else (np.zeros(0, np.int64),) * 3
        return pd.DataFrame({"query_id": qids[at], "vec_id": ids, "score": scores})

    out = a.groupBy("_q", "_r").cogroup(b.groupBy("_q", "_r")).applyInPandas(meet, BEST)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
