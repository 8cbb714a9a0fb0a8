"""Stored posting lists with bounds, and exact BM25 search with list pruning.

Documents are dealt to segments of a bounded size. A task turns a segment's token
lists into postings part by part, without a row for every token, so that it holds a
bounded number of words, however long the texts are: one row per (part of a segment,
term) with the documents, the word's count and the document's length, and the
greatest count and least length of the row, which bound all of its scores. A
query's lists of a segment are ordered by that bound; lists
whose bounds together cannot reach the k-th best score found so far add no new
documents and are only looked up for documents that can still reach it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sievework.functions.topk import best_rows

K1, B = 1.2, 0.75
POSTINGS = "segment int, term string, items array<bigint>, counts array<int>, sizes array<int>, most int, least int"
SEGMENT_ROWS = 32_768
# Words that a task holds at a time while it turns a segment into postings.
PART_WORDS = 1_000_000
SLACK = 2e-6
_ARROW = pa.schema(
    [("segment", pa.int32()), ("term", pa.string()), ("items", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("most", pa.int32()), ("least", pa.int32())]
)


class Postings:
    """A stored index: posting rows, document frequencies and corpus figures."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
        self.terms = spark.read.schema("term string, df bigint").parquet(f"{path}/terms")
        self.corpus = spark.read.schema("n bigint, average double").parquet(f"{path}/corpus")


def weight(count: np.ndarray, size: np.ndarray, average: float) -> np.ndarray:
    """A posting's share of BM25 before idf."""
    return count * (K1 + 1) / (count + K1 * (1 - B + B * size / average))


def _invert(segment: int, ids: np.ndarray, lists: pa.ListArray) -> pa.RecordBatch:
    """All posting rows of one segment from its documents' token lists."""
    coded = lists.flatten().dictionary_encode()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    n_terms = len(coded.dictionary)
    code = np.repeat(np.arange(sizes.size), sizes) + coded.indices.to_numpy().astype(np.int64) * sizes.size
    pair, count = np.unique(code, return_counts=True)
    term, doc = pair // max(1, sizes.size), pair % max(1, sizes.size)
    bounds = np.searchsorted(term, np.arange(n_terms + 1)).astype(np.int32)
    most = np.maximum.reduceat(count, bounds[:-1]) if n_terms else count
    least = np.minimum.reduceat(sizes[doc], bounds[:-1]) if n_terms else count
    listed = lambda v, kind: pa.ListArray.from_arrays(bounds, pa.array(v, kind))
    cols = [
        pa.array(np.full(n_terms, segment), pa.int32()), coded.dictionary.cast(pa.string()), listed(ids[doc], pa.int64()), listed(count, pa.int32()),
        listed(sizes[doc], pa.int32()), pa.array(most, pa.int32()), pa.array(least, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(cols, schema=_ARROW)


def build_postings(items: DataFrame, tokens: Column, path: str, segment_rows: int = SEGMENT_ROWS) -> Postings:
    """Writes the posting index of items(item_id, ...) under ``path``. ``tokens`` is
    the list of a row's words; a row without words is only counted."""
    spark = items.sparkSession
    n = items.count()
    segments = max(1, ceil(n / segment_rows), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = items.select("item_id", tokens.alias("w")).withColumn("segment", F.pmod(F.xxhash64("item_id"), F.lit(segments)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words, now = 0, -1

        def emit() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            order = np.argsort(t.column("item_id").to_numpy(), kind="stable")
            t = t.take(pa.array(order)).combine_chunks()
            return _invert(now, t.column("item_id").to_numpy(), t.column("w").combine_chunks())

        for b in batches:
            seg, ends = b.column("segment").to_numpy(), b.column("w").offsets.to_numpy()
            at = 0
            while at < len(seg):
                if held and (seg[at] != now or words >= PART_WORDS):
                    yield emit()
                    held, words = [], 0
                    pa.default_memory_pool().release_unused()
                now = int(seg[at])
                # Rows of one segment, up to the one that fills the part.
                end = min(int(np.searchsorted(seg, now, "right")), int(np.searchsorted(ends, ends[at] + PART_WORDS - words)))
                end = max(end, at + 1)
                held.append(b.slice(at, end - at))
                words += int(ends[end] - ends[at])
                at = end
        if held:
            yield emit()
        pa.default_memory_pool().release_unused()

    sorted_ = dealt.select("segment", "item_id", "w").repartition(F.col("segment")).sortWithinPartitions("segment")
    sorted_.mapInArrow(run, POSTINGS).write.parquet(f"{path}/postings")
    rows = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    words = F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c))
    terms = rows.groupBy("term").agg(F.sum(F.size("items")).cast("bigint").alias("df"), words.alias("words"))
    terms.write.parquet(f"{path}/terms")
    every = spark.read.parquet(f"{path}/terms").agg(F.coalesce(F.sum("words"), F.lit(0)))
    average = (every.first()[0] / n or 1.0) if n else 1.0
    spark.createDataFrame([(n, average)], "n bigint, average double").coalesce(1).write.parquet(f"{path}/corpus")
    return Postings(spark, path)


def _scores(lists: list[tuple[np.ndarray, np.ndarray, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(items, scores) of all documents that can be among the k best of one query in
    one segment. lists: (items ascending, contributions, greatest contribution)."""
    lists = sorted(lists, key=lambda x: -x[2])
    rest = np.concatenate([np.cumsum([x[2] for x in lists][::-1])[::-1][1:], [0.0]])
    ids, score, least, at = np.zeros(0, np.int64), np.zeros(0), 0.0, 0
    # Lists that can still bring a new document among the best.
    while at < len(lists) and (at == 0 or rest[at - 1] + SLACK >= least):
        step = max(1, at)
        own = lists[at : at + step]
        every = np.concatenate([ids, *[x[0] for x in own]])
        parts = np.concatenate([score, *[x[1] for x in own]])
        ids, where = np.unique(every, return_inverse=True)
        score = np.bincount(where, parts, ids.size)
        at += len(own)
        if ids.size >= k:
            least = max(least, float(np.partition(score, -k)[-k]))
    # The others are looked up for documents that can still reach the k-th score.
    for items, parts, _ in lists[at:]:
        keep = score + rest[at - 1] + SLACK >= least
        ids, score = ids[keep], score[keep]
        place = np.minimum(np.searchsorted(items, ids), items.size - 1)
        score = score + np.where(items[place] == ids, parts[place], 0.0)
        at += 1
        if ids.size >= k:
            least = max(least, float(np.partition(score, -k)[-k]))
    return ids, score


def _joined(parts: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray, float]:
    """One list of a term from those of a segment's parts."""
    items = np.concatenate([p[0] for p in parts])
    order = np.argsort(items, kind="stable")
    return items[order], np.concatenate([p[1] for p in parts])[order], max(p[2] for p in parts)


def bm25_search(queries: DataFrame, index: Postings, k: int, tile_queries: int = 2048) -> DataFrame:
    """(query_id, item_id, score, rank): exact BM25 top-k of queries(query_id,
    terms: distinct words), by (rounded score desc, id asc); no score, no row.

    Only postings of asked terms are read. Queries meet a segment in tiles, so
    neither many queries nor a hot term fill one task, and only k rows a query
    leave a segment."""
    each = queries.select("query_id", F.explode("terms").alias("term"))
    total, average = index.corpus.select("n", "average").first()
    n = F.lit(total)
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = each.join(index.terms, "term").select("query_id", F.struct("term", idf.alias("idf")).alias("t"))
    tiles = max(1, ceil(queries.count() / tile_queries))
    tile = F.pmod(F.xxhash64("query_id"), F.lit(tiles))
    asked = weighed.groupBy("query_id").agg(F.collect_list("t").alias("terms")).withColumn("tile", tile)
    segments = (index.rows.agg(F.max("segment")).first()[0] or 0) + 1
    every = lambda count, kind: F.explode(F.sequence(F.lit(0).cast(kind), F.lit(count - 1).cast(kind)))
    asked = asked.withColumn("segment", every(segments, "int")).select("segment", "tile", "query_id", F.col("terms.term").alias("terms"), F.col("terms.idf").alias("idfs"))
    wanted = index.rows.join(each.select("term").distinct(), "term", "left_semi").withColumn("tile", every(tiles, "bigint"))

    def meet(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        tops = weight(rows["most"].to_numpy(float), rows["least"].to_numpy(float), average)
        parts: dict[str, list] = {}
        for t, i, c, z, m in zip(rows["term"], rows["items"], rows["counts"], rows["sizes"], tops):
            parts.setdefault(t, []).append((i, weight(np.asarray(c, float), z, average), m))
        held = {t: p[0] if len(p) == 1 else _joined(p) for t, p in parts.items()}
        out = []
        for query, terms, idfs in zip(q["query_id"], q["terms"], q["idfs"]):
            lists = [(held[t][0], held[t][1] * f, held[t][2] * f) for t, f in zip(terms, idfs) if t in held]
            if lists:
                ids, scores = _scores(lists, k)
                out.append(best_rows(np.array([query]), ids, scores[None, :], k))
        none = best_rows(np.array([], "int64"), np.array([], "int64"), np.zeros((0, 0)), k)
        return pd.concat(out) if out else none

    found = asked.groupBy("segment", "tile").cogroup(wanted.groupBy("segment", "tile")).applyInPandas(meet, "query_id bigint, item_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
