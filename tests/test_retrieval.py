"""Top-k paths, guards and entity resolution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import knowledge as G, retrieval as R
from sievework.session import table


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return q, e.where("vec_id % 25 <> 0").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


def rows(d):
    return sorted((r.query_id, r.rank, r.item_id, r.score) for r in d.collect())


def test_tiled_path_equals_held_path(spark, sf):
    q, i = vectors(spark, sf)
    assert rows(R.dense_topk(q, i, 7)) == rows(R.dense_topk(q, i, 7, query_bound=6, tile_rows=90))


def test_ann_with_all_buckets_is_exact(spark, sf):
    q, i = vectors(spark, sf)
    a = R.ann_topk(q, i, 5, 64, 1, 3, tile_rows=60)  # one plane: own bucket and its neighbour are all
    assert rows(a) == rows(R.dense_topk(q, i, 5))


def test_bm25_tiled_equals_held(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    assert rows(R.bm25_topk(q, d, 4)) == rows(R.bm25_topk(q, d, 4, query_bound=9))


def test_late_interaction_brute_force(spark):
    q = spark.createDataFrame([(1, "red blue red")], "query_id long, text string")
    d = spark.createDataFrame([(5, "blue green"), (6, "red blue")], "item_id long, text string")
    c = spark.createDataFrame([(1, 5), (1, 6)], "query_id long, item_id long")
    got = {r.item_id: r.score for r in R.late_interaction(c, q, d).collect()}
    v = lambda t: R._token_vector(t, 16)
    for item, words in ((5, ["blue", "green"]), (6, ["red", "blue"])):
        assert got[item] == pytest.approx(sum(max(float(np.dot(v(a), v(b))) for b in words) for a in ["red", "blue", "red"]), abs=1e-5)


def test_guard_refuses_unfiltered_reads(spark):
    g = R.Guarded(spark.createDataFrame([(1, 1, "a"), (2, 1, None), (3, 2, "a")], "id int, project int, grp string"), "project", "grp")
    with pytest.raises(PermissionError):
        g.select("id")
    claims = spark.createDataFrame([(1, "a")], "project int, grp string")
    assert [r.id for r in g.visible(claims).collect()] == [1]


def test_weak_names_do_not_merge_strong_identities(spark):
    m = [(1, "jonathan", "b", "s1"), (2, "jonathan", "b", "s2"), (3, "jonathon", "b", None), (4, "maria", "b", "s3"), (5, "marla", "b", None), (6, "jonathan", "c", "s1")]
    out = {r.mention_id: r.entity for r in G.resolve_entities(spark.createDataFrame(m, "mention_id long, name string, block string, strong_id string"), 0.25).collect()}
    assert out[1] == out[6] != out[2]
    assert out[3] not in (out[1], out[2])  # near both: neither, and apart
    assert out[4] == out[5]


def test_structured_query_refuses(spark, sf):
    t = {"orders": (table(spark, sf, "orders"), ["o_orderstatus"])}
    for spec in ({"table": "x"}, {"table": "orders", "group": ["o_custkey"]}, {"table": "orders", "drop": 1}, {"table": "orders", "group": ["o_orderstatus"], "limit": 999}):
        with pytest.raises(PermissionError):
            G.structured_query(t, spec, 10)
