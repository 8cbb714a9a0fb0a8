"""Lexical, dense and hybrid retrieval, access filters, answers and metrics."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from sievework.functions.columns import h32, let, ratio, words
from sievework.functions.ivf import build_ivf, ivf_topk
from sievework.functions.postings import Postings, build_postings, bm25_search
from sievework.functions.topk import cosine_scorer, tiled_topk
from sievework.operators.evaluation import bootstrap_ci
from sievework.operators.text import squeeze
from sievework.session import scratch_path

def tokens(c: Column) -> Column:
    return words(squeeze(c))


def _hash_vectors(dim: int):
    @pandas_udf(ArrayType(DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        def one(h):
            if h is None:
                return None
            h = np.asarray(h, dtype=np.int64)
            v = np.bincount(h % dim, weights=np.where((h // dim) % 2 == 0, 1.0, -1.0), minlength=dim) if h.size else np.zeros(dim)
            n = np.sqrt((v * v).sum())
            return v / n if n > 0 else v

        return s.map(one)

    # marked so that the optimizer does not copy the call into inferred filters
    return run.asNondeterministic()


def hash_embed(df: DataFrame, key: str, text: str, dim: int, max_tokens: int, revision: str = "signed-hash-1") -> DataFrame:
    """(key, vector, status, revision, dim): signed feature hashing with L2
    norm. Oversize input is rejected, not cut. One pass, no shuffle."""
    hs = let(tokens(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), F.transform(w, lambda t: h32(t)).alias("h")))
    d = df.select(key, hs.alias("_t"))
    fits = F.col("_t.n") <= max_tokens
    return d.select(
        key, F.when(fits, _hash_vectors(dim)(F.when(fits, F.col("_t.h")))).alias("vector"), F.when(fits, "ok").otherwise("rejected").alias("status"),
        F.lit(revision).alias("revision"), F.lit(dim).alias("dim"),
    )


def dense_topk(
    queries: DataFrame, index: DataFrame, k: int, query_bound: int = 4096, tile_rows: int = 50_000, skip_self: bool = False,
    where: Column | None = None, citation: str | None = None,
) -> DataFrame:
    """Exact cosine top-k. queries(query_id, vector), index(item_id, vector).

    ``where`` filters the index before the search; ``citation`` names an index
    column that each result carries."""
    kept = index if where is None else index.where(where)
    found = tiled_topk(queries, kept.select("item_id", "vector"), k, cosine_scorer, query_bound, tile_rows, skip_self)
    return found if citation is None else found.join(index.select("item_id", F.col(citation).alias("citation")), "item_id")


def ann_topk(queries: DataFrame, index: DataFrame, k: int, dim: int, planes: int, seed: int, tile_rows: int = 50_000) -> DataFrame:
    """Nearest rows by cosine from an inverted file whose lists number twice the
    buckets of ``planes`` planes; exact, since list radii and code errors bound
    what is not read. ``dim`` must be the vectors' length."""
    if index.where(F.size("vector") != dim).limit(1).count():
        raise ValueError(f"vectors must have {dim} numbers")
    stored = build_ivf(index, scratch_path(index.sparkSession, "ivf"), lists=2 << planes, seed=seed)
    return ivf_topk(queries, stored, k, tile_rows=tile_rows)


def recall_against(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of each query's exact results that a search found."""
    hit = exact.join(found.select("query_id", "item_id").withColumn("_h", F.lit(True)), ["query_id", "item_id"], "left")
    return hit.groupBy("query_id").agg(F.round(F.count_if("_h") / F.count(F.lit(1)), 6).alias("recall"))


def bm25_index(items: DataFrame) -> Postings:
    """Posting index of items(item_id, text) in the shared folder."""
    return build_postings(items, tokens(F.col("text")), scratch_path(items.sparkSession, "postings"))


def bm25_topk(queries: DataFrame, items: DataFrame | Postings, k: int, query_bound: int = 2048) -> DataFrame:
    """BM25 top-k. queries(query_id, text), items(item_id, text) or their stored
    posting index, which later searches need not build again. Queries meet the
    index in tiles of ``query_bound``."""
    index = items if isinstance(items, Postings) else bm25_index(items)
    return bm25_search(queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("terms")), index, k, query_bound)


def fuse_rrf(lists: Sequence[DataFrame], k0: int, k: int) -> DataFrame:
    """Sum of 1 / (k0 + rank); a list without the item adds nothing."""
    u = reduce(DataFrame.unionByName, [x.select("query_id", "item_id", "rank") for x in lists])
    g = u.groupBy("query_id", "item_id").agg(F.round(F.sum(1.0 / (F.lit(k0) + F.col("rank"))), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scaled_scores(lists: Sequence[DataFrame]) -> DataFrame:
    """(query_id, item_id, s0, s1, ...): min-max scores per list and query."""
    u = reduce(DataFrame.unionByName, [x.select("query_id", "item_id", "score", F.lit(i).alias("_l")) for i, x in enumerate(lists)])
    span = u.groupBy("query_id", "_l").agg(F.min("score").alias("_a"), F.max("score").alias("_b"))
    n = F.when(F.col("_b") > F.col("_a"), (F.col("score") - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(1.0)
    return u.join(span, ["query_id", "_l"]).groupBy("query_id", "item_id").agg(*[F.coalesce(F.max(F.when(F.col("_l") == i, n)), F.lit(0.0)).alias(f"s{i}") for i in range(len(lists))])


def fuse_weighted(lists: Sequence[DataFrame], weights: Sequence[float], k: int) -> DataFrame:
    s = scaled_scores(lists)
    score = F.round(reduce(lambda a, iw: a + F.col(f"s{iw[0]}") * iw[1], enumerate(weights), F.lit(0.0)), 9)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return s.select("query_id", "item_id", score.alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tune_weights(lists: Sequence[DataFrame], grid: Sequence[Sequence[float]], qrels: DataFrame, train: Column, k: int) -> DataFrame:
    """Mean recall@k per weight setting on train queries; the chosen setting is
    the only one reported on test queries."""
    s = scaled_scores(lists)
    g = s.withColumn("_g", F.explode(F.array(*[F.struct(F.lit(i).alias("setting"), *[F.lit(float(x)).alias(f"w{j}") for j, x in enumerate(ws)]) for i, ws in enumerate(grid)])))
    score = F.round(reduce(lambda a, j: a + F.col(f"s{j}") * F.col(f"_g.w{j}"), range(len(lists)), F.lit(0.0)), 9)
    w = Window.partitionBy("query_id", "setting").orderBy(F.desc("score"), "item_id")
    top = g.select("query_id", "item_id", F.col("_g.setting").alias("setting"), score.alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    hit = top.join(qrels, ["query_id", "item_id"], "left_semi").groupBy("query_id", "setting").agg(F.count(F.lit(1)).alias("h"))
    rel = qrels.groupBy("query_id").agg(F.count_distinct("item_id").alias("r")).withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    per = rel.join(hit, ["query_id", "setting"], "left").withColumn("recall", F.coalesce("h", F.lit(0)) / F.col("r")).withColumn("_tr", train)
    m = per.groupBy("setting").agg(F.round(F.avg(F.when(F.col("_tr"), F.col("recall"))), 6).alias("train_recall"), F.round(F.avg(F.when(~F.col("_tr"), F.col("recall"))), 6).alias("_test"))
    best = m.agg(F.max_by("setting", F.struct("train_recall", -F.col("setting")))).scalar()
    m = m.withColumn("_best", best)
    return m.select("setting", "train_recall", (F.col("setting") == F.col("_best")).alias("chosen"), F.when(F.col("setting") == F.col("_best"), F.col("_test")).alias("test_recall"))


class Guarded:
    """Rows that can only be read through a claims filter."""

    def __init__(self, rows: DataFrame, project: str, group: str) -> None:
        self._rows, self._project, self._group = rows, project, group

    def __getattr__(self, name: str):
        raise PermissionError("rows are readable only through visible(claims)")

    def visible(self, claims: DataFrame) -> DataFrame:
        return acl_filter(self._rows, claims, self._project, self._group)


def acl_filter(rows: DataFrame, claims: DataFrame, project: str, group: str) -> DataFrame:
    """Rows whose project and group are claimed; a missing ACL never matches.
    claims(project, grp) are data from the identity side, not query text."""
    c = claims.select(F.col("project").alias(project), F.col("grp").alias(group)).distinct()
    return rows.join(c, [project, group], "left_semi")


def rerank(cands: DataFrame, features: DataFrame, weights: dict[str, float], n: int) -> DataFrame:
    """Reorders the first n candidates by a weighted feature score. A candidate
    without features keeps its retrieval order after the scored ones, flagged."""
    c = cands.where(F.col("rank") <= n).join(features, ["query_id", "item_id"], "left")
    score = F.round(reduce(lambda a, kv: a + F.col(kv[0]) * kv[1], weights.items(), F.lit(0.0)), 9)
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank", "item_id")
    return c.withColumn("rerank_score", score).withColumn("fallback", F.col("rerank_score").isNull()).withColumn("final_rank", F.row_number().over(w)).select(
        "query_id", "item_id", "rank", "rerank_score", "fallback", "final_rank"
    )


def overlap_features(cands: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """Token overlap and length closeness of each candidate."""
    j = cands.join(queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("_q")), "query_id")
    j = j.join(items.select("item_id", tokens(F.col("text")).alias("_d")), "item_id").where(F.size("_d") > 0)
    inter = F.size(F.array_intersect("_q", "_d"))
    return j.select(
        "query_id", "item_id", F.round(inter / F.greatest(F.size("_q"), F.lit(1)), 6).alias("overlap"),
        F.round(F.least(F.size("_q"), F.size("_d")) / F.greatest(F.size("_q"), F.size("_d")), 6).alias("closeness"),
    )


def _signs(c: Column, dim: int) -> Column:
    """Vectors of words, ``dim`` bytes each, one after another."""
    return F.to_binary(F.array_join(F.transform(c, lambda t: F.substring(F.md5(t), 1, 2 * dim)), ""), F.lit("hex"))


def _token_vector(t: str, dim: int) -> np.ndarray:
    """One word's vector of length 1, as the index holds it by bytes."""
    v = np.frombuffer(hashlib.md5(t.encode()).digest()[:dim], dtype=np.uint8).astype("float64") - 127.5
    return v / np.sqrt((v * v).sum())


def token_index(items: DataFrame, path: str, dim: int = 16) -> DataFrame:
    """Writes (item_id, item_vectors, vectors): every distinct word of an item as a
    vector of ``dim`` bytes, made once. Returns the stored table."""
    words_ = items.select("item_id", F.array_distinct(tokens(F.col("text"))).alias("_w"))
    words_.select("item_id", F.size("_w").alias("item_vectors"), _signs(F.col("_w"), dim).alias("vectors")).write.parquet(path)
    return items.sparkSession.read.parquet(path)


def index_size(index: DataFrame) -> DataFrame:
    """Items, vectors and bytes of a token index."""
    return index.agg(F.count(F.lit(1)).alias("items"), F.sum("item_vectors").alias("vectors"), F.sum(F.length("vectors")).alias("bytes"))


def late_interaction(cands: DataFrame, queries: DataFrame, items: DataFrame, dim: int = 16) -> DataFrame:
    """MaxSim: for each query token its best item token, summed; plus the item's
    vectors. ``items`` is a stored token index, or (item_id, text) that one is made
    of. Token vectors are derived from token hashes, once for each item; a pair
    costs one small matrix product."""
    index = items if "vectors" in items.columns else token_index(items.join(cands.select("item_id").distinct(), "item_id", "left_semi"), scratch_path(cands.sparkSession, "token-index"), dim)

    @pandas_udf(DoubleType())
    def maxsim(q: pd.Series, d: pd.Series) -> pd.Series:
        def unit(raw) -> np.ndarray:
            v = np.frombuffer(raw, np.uint8).reshape(-1, dim).astype(np.float64) - 127.5
            return v / np.sqrt((v * v).sum(axis=1, keepdims=True))

        return pd.Series([float((unit(a) @ unit(b).T).max(axis=1).sum()) if len(a) and len(b) else 0.0 for a, b in zip(q, d)], index=q.index, dtype=float)

    j = cands.join(queries.select("query_id", _signs(tokens(F.col("text")), dim).alias("_q")), "query_id").join(index, "item_id")
    s = j.select("query_id", "item_id", F.round(maxsim("_q", "vectors"), 6).alias("score"), "item_vectors")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return s.withColumn("rank", F.row_number().over(w))


def build_context(ranked: DataFrame, items: DataFrame, budget: int) -> DataFrame:
    """Best-first items while the running token count fits; the citation list is
    exactly the used items. items(item_id, tokens)."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    u = ranked.join(items, "item_id").withColumn("_sum", F.sum("tokens").over(w)).where(F.col("_sum") <= budget)
    return u.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("citations"), F.sum("tokens").alias("tokens"))


def check_citations(answers: DataFrame, context: DataFrame, texts: DataFrame) -> DataFrame:
    """Verdict per citation. answers(answer_id, query_id, cites array<struct<
    item_id, start, quote>>), context(query_id, item_id), texts(item_id, text)."""
    c = answers.select("answer_id", "query_id", F.inline("cites"))
    j = c.join(context.select("query_id", "item_id").distinct().withColumn("_in", F.lit(True)), ["query_id", "item_id"], "left").join(texts, "item_id", "left")
    exact = F.expr("substring(text, start + 1, length(quote))") == F.col("quote")
    verdict = F.when(F.col("text").isNull(), "forged").when(F.col("_in").isNull(), "not_in_context").when(~exact, "offset_mismatch").otherwise("valid")
    return j.select("answer_id", "item_id", verdict.alias("verdict"))


def abstain(cands: DataFrame, queries: DataFrame, min_score: float, min_gap: float, min_items: int, floor: float) -> DataFrame:
    """Answer or abstain per query; a query whose items are denied and one whose
    items do not exist get the same reason."""
    g = cands.groupBy("query_id").agg(
        F.max("score").alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.count_if(F.col("score") >= floor).alias("items")
    )
    q = queries.select("query_id").distinct().join(g, "query_id", "left")
    why = F.when(F.col("top").isNull(), "no_evidence").when(F.col("top") < min_score, "low_score").when(F.col("items") < min_items, "few_items").when(F.col("top") - F.coalesce("second", F.lit(0.0)) < min_gap, "ambiguous")
    return q.select("query_id", F.when(why.isNull(), "answer").otherwise("abstain").alias("decision"), F.coalesce(why, F.lit("supported")).alias("reason"))


def ir_metrics(ranked: DataFrame, qrels: DataFrame, k: int, denied: DataFrame | None = None) -> DataFrame:
    """Per query: recall, precision, reciprocal rank and nDCG at k. Relevant
    items the caller may not read are left out of the truth."""
    rel = qrels.select("query_id", "item_id").distinct()
    if denied is not None:
        rel = rel.join(denied, ["query_id", "item_id"], "left_anti")
    hits = ranked.where(F.col("rank") <= k).join(rel, ["query_id", "item_id"], "left_semi")
    per = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("h"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1)).alias("dcg"))
    n = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("r"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("r"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i.cast("double") + 1))
    j = n.join(per, "query_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        "query_id", "r", F.round(z(F.col("h") / F.col("r")), 6).alias("recall"), F.round(z(F.col("h") / k), 6).alias("precision"),
        F.round(z(1.0 / F.col("first")), 6).alias("mrr"), F.round(z(F.col("dcg")) / ideal, 6).alias("ndcg"),
    )


def answer_metrics(judged: DataFrame) -> DataFrame:
    """By label source: cited-answer accuracy (correct without a citation is
    wrong), unsupported rate, abstention quality.

    judged(label_source, answered, correct, cited, supported, answerable)."""
    a = F.col("answered")
    b = lambda c: c.cast("double")
    return judged.groupBy("label_source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(a, b(F.col("correct") & F.col("cited")))), 6).alias("cited_accuracy"),
        F.round(F.avg(F.when(a, b(~F.col("supported")))), 6).alias("unsupported_rate"),
        F.round(ratio(F.count_if(~a & ~F.col("answerable")), F.count_if(~a)), 6).alias("abstention_precision"),
        F.round(ratio(F.count_if(~a & ~F.col("answerable")), F.count_if(~F.col("answerable"))), 6).alias("abstention_recall"),
    )


def ablation(runs: DataFrame, baseline: str, b: int, seed: str) -> DataFrame:
    """Metric, latency and cost by route x class x partition with subtotals, the
    delta to the baseline route, and a bootstrap interval per route.

    runs(route, cls, part, query_id, metric, latency_ms, cost)."""
    g = runs.groupingSets([["route", "cls", "part"], ["route", "cls"], ["route", "part"], ["route"]], "route", "cls", "part").agg(
        F.grouping("cls").alias("_gc"), F.grouping("part").alias("_gp"), F.count(F.lit(1)).alias("n"), F.avg("metric").alias("metric"), F.avg("latency_ms").alias("latency_ms"), F.sum("cost").alias("cost")
    )
    g = g.select("route", F.when(F.col("_gc") == 1, "(all)").otherwise(F.col("cls")).alias("cls"), F.when(F.col("_gp") == 1, "(all)").otherwise(F.col("part")).alias("part"), "n", "metric", "latency_ms", "cost")
    base = g.where(F.col("route") == baseline).select("cls", "part", F.col("metric").alias("_b"))
    ci = bootstrap_ci(runs, "query_id", F.col("metric"), F.lit(1), b, seed, buckets=64, by=["route"]).select("route", "low", "high")
    j = g.join(base, ["cls", "part"], "left").join(ci, "route")
    whole = (F.col("cls") == "(all)") & (F.col("part") == "(all)")
    return j.select(
        "route", "cls", "part", "n", *[F.round(c, 6).alias(c) for c in ("metric", "latency_ms", "cost")], F.round(F.col("metric") - F.col("_b"), 6).alias("delta"),
        F.when(whole, F.col("low")).alias("low"), F.when(whole, F.col("high")).alias("high"),
    )


