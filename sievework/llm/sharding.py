"""Uniform shuffle into shards of exact sizes by a hypergeometric matrix.

Rows of P source partitions go to B buckets of exact sizes. The number of rows
from partition i to bucket j is what a uniform permutation of all rows would
give: a table with row sums c_i and column sums n_j from the multivariate
hypergeometric law. The matrix is never built. A binary tree over the partitions
splits the bucket sizes top down (the left half of a node receives a multivariate
hypergeometric draw, seeded by the node), so each task derives its own row from
the partition sizes alone, in log2(P) draws, and a task that runs again draws the
same. Rows are then dealt by a random permutation of the row's labels, exchanged,
and permuted again inside each bucket by random keys. A shard is a run of
consecutive buckets, so its rows are spread over many tasks, and slots follow
from the known bucket sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, lgamma

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

NUMPY_LIMIT = 10**9


def hypergeometric(good: int, bad: int, drawn: int, rng: np.random.Generator) -> int:
    """Good ones among ``drawn`` of good + bad; past numpy's limit by inversion
    from the mode outwards."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn and good else 0
    lo, hi = max(0, drawn - bad), min(good, drawn)
    mode = min(hi, max(lo, (drawn + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    p = exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    u = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while u > 0 and (up < hi and p_up > 0 or down > lo and p_down > 0):
        if up < hi:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > lo:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def split_sizes(sizes: np.ndarray, drawn: int, rng: np.random.Generator) -> np.ndarray:
    """Multivariate hypergeometric draw: how many of each bucket's places."""
    if sizes.sum() < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(sizes, drawn, method="marginals")
    out = np.zeros_like(sizes)
    rest = int(sizes.sum())
    for j, n in enumerate(sizes.tolist()):
        rest -= n
        out[j] = hypergeometric(n, rest, drawn, rng)
        drawn -= int(out[j])
    return out


def matrix_row(counts: np.ndarray, sizes: np.ndarray, i: int, seed: int) -> np.ndarray:
    """Row i of the communication matrix."""
    before = np.concatenate([[0], np.cumsum(counts)])
    lo, hi, node = 0, len(counts), 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split_sizes(sizes, int(before[mid] - before[lo]), np.random.default_rng([seed, node]))
        if i < mid:
            sizes, hi, node = left, mid, 2 * node
        else:
            sizes, lo, node = sizes - left, mid, 2 * node + 1
    return sizes


def even(total: int, parts: int) -> np.ndarray:
    """Sizes that differ by one at most."""
    return np.array([total // parts + (k < total % parts) for k in range(parts)], np.int64)


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 7, bucket_rows: int = 50_000) -> DataFrame:
    """All rows and columns of ``df`` with shard and slot (gapless from 0).

    Shard counts differ by one row at most. Null values, repeated rows, empty and
    long texts are rows like any other; an empty table gives no rows. ``df`` is
    read twice and must have the same partitions both times (a file scan or a
    checkpoint); a task that finds another row count stops with an error.
    A column named shard, slot, _bucket or _key of ``df`` is replaced."""
    df = df.drop("shard", "slot", "_bucket", "_key")
    found = {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.array([found.get(p, 0) for p in range(max(found, default=-1) + 1)], np.int64)
    total = int(counts.sum())
    per_shard = even(total, shards)
    each = max(1, ceil(max(1, total) / shards / bucket_rows))
    sizes = np.concatenate([even(int(n), each) for n in per_shard])
    held = df.sparkSession.sparkContext.broadcast((counts, sizes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = held.value
        i = TaskContext.get().partitionId()
        mine = int(counts[i]) if i < len(counts) else 0
        rng = np.random.default_rng([seed, 0, i])
        labels = np.repeat(np.arange(sizes.size, dtype=np.int32), matrix_row(counts, sizes, i, seed)) if mine else np.zeros(0, np.int32)
        rng.shuffle(labels)
        at = 0
        for b in batches:
            if at + b.num_rows > mine:
                break
            keys = rng.integers(-(2**63), 2**63, b.num_rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(labels[at : at + b.num_rows]), pa.array(keys)], names=[*b.schema.names, "_bucket", "_key"])
            at += b.num_rows
        if at != mine:
            raise ValueError(f"partition {i} has other rows than when they were counted; checkpoint the input first")

    fields = T.StructType([*df.schema.fields, T.StructField("_bucket", T.IntegerType()), T.StructField("_key", T.LongType())])
    dealt = df.mapInArrow(deal, fields)
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key")) - 1
    out = dealt.withColumn("_at", local.cast("bigint")).withColumn("shard", F.floor(F.col("_bucket") / F.lit(each)).cast("int"))
    # Sizes of the buckets of a shard differ by one at most, so a bucket's first slot is arithmetic.
    k = F.col("_bucket") % F.lit(each)
    size = F.floor(F.lit(total) / F.lit(shards)) + (F.col("shard") < F.lit(total % shards)).cast("bigint")
    start = k * F.floor(size / F.lit(each)) + F.least(k, size % F.lit(each))
    return out.withColumn("slot", (F.col("_at") + start).cast("bigint")).drop("_bucket", "_key", "_at")
