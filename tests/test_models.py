"""Results of learned models, which have no SQL twin, and exact vector search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sievework.functions import ivf, topk
from sievework.operators import privacy, recommend as R
from sievework.session import scratch_path


def run(spark, sf, name):
    return entry.queries()[name](spark, sf).collect()


def test_boosted_trees_beat_the_majority(spark, sf):
    rows = {r.split: r for r in run(spark, sf, "M7_train_gbt")}
    assert rows["train"].accuracy >= rows["train"].majority_accuracy and 0 < rows["test"].accuracy <= 1


def test_batch_scores_once_per_run_key(spark, sf):
    rows = run(spark, sf, "M8_batch_score")
    assert len(rows) == len({r.doc_id for r in rows}) > 0 and {r.model_version for r in rows} == {"0.1.0"}
    assert all((r.label == "positive") == (r.prediction == 1) and 0 <= r.probability <= 1 for r in rows)
    assert len({r.probability for r in rows}) > 3


def test_clusters_agree_across_seeds(spark, sf):
    rows = run(spark, sf, "M31_embed_clusters")
    assert len(rows) == 3 and all(0.5 < r.rand_index <= 1 and r.clusters == 10 for r in rows)


def test_search_logs_scores_and_one_choice(spark, sf):
    rows = run(spark, sf, "M32_budgeted_search")
    assert [r.trial for r in rows] == [0, 1, 2] and sum(r.chosen for r in rows) == 1
    best = max(rows, key=lambda r: (r.inner_score, -r.trial))
    assert best.chosen and all(0 <= r.inner_score <= 1 and 0 <= r.outer_score <= 1 for r in rows)


def frame(spark, x, name="item_id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} bigint, vector array<double>")


def exact(q, x, k):
    s = np.round(ivf.unit(q) @ ivf.unit(x).T, 6)
    return {(i, int(j), r + 1) for i, row in enumerate(s) for r, j in enumerate(np.lexsort((np.arange(len(x)), -row))[:k])}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 24)) * 4
    x = centres[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 24)) * 0.4
    x[7] = 0
    x[100:110] = x[99]
    return x, np.concatenate([x[::97] + rng.standard_normal(x[::97].shape) * 0.1, np.zeros((1, 24)), x[99:100]])


def test_inverted_file_is_exact_and_reads_little(spark, clustered):
    x, q = clustered
    index = ivf.build_ivf(frame(spark, x), scratch_path(spark, "ivf"), lists=40, sample=1000)
    queries = frame(spark, q, "query_id")
    found = {(r.query_id, r.item_id, r.rank) for r in ivf.ivf_topk(queries, index, 10, first=1).collect()}
    assert found == exact(q, x, 10)
    pairs, lists = ivf.candidates(queries.where("query_id < 31"), index, 10, first=1)
    # Exact scores for few rows, and codes of few lists where rows lie in clusters.
    assert pairs.count() < 0.05 * 31 * len(x)
    assert lists.count() < 0.25 * 31 * index.lists.count()


def test_inverted_file_edges(spark):
    none = frame(spark, np.zeros((0, 3)))
    index = ivf.build_ivf(none, scratch_path(spark, "ivf"))
    assert ivf.ivf_topk(frame(spark, np.eye(3), "query_id"), index, 2).collect() == []
    two = ivf.build_ivf(frame(spark, np.eye(3)[:2]), scratch_path(spark, "ivf"))
    assert ivf.ivf_topk(frame(spark, np.eye(3), "query_id"), two, 5).count() == 6


def test_index_scores_few_rows_of_the_given_vectors(spark):
    """Without clusters all lists are read, but few rows are scored by vectors."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    i = e.where("vec_id % 25 <> 0").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    pairs, _ = ivf.candidates(q, ivf.build_ivf(i, scratch_path(spark, "ivf")), 10)
    assert pairs.count() < 0.25 * q.count() * i.count()


def test_nearest_copies_equal_brute_force(spark, clustered):
    x, _ = clustered
    real, syn = x[:1500], np.concatenate([x[:20], x[2000:2030]])
    rows, summary = privacy.nearest_copies(frame(spark, syn, "id"), frame(spark, real, "id"), frame(spark, x[1500:], "id"), "id", "vector")
    want = np.round(1 - np.round((ivf.unit(syn) @ ivf.unit(real).T).max(1), 6), 6)
    got = {r.id: r for r in rows.collect()}
    assert [got[i].train_distance for i in range(len(syn))] == want.tolist()
    assert summary.first().exact_copies == int((want <= 1e-6).sum())


def interactions(spark):
    rng = np.random.default_rng(1)
    rows = [(u, int(i), 0) for u in range(60) for i in rng.choice(80, rng.integers(1, 12))] + [(99, i, 0) for i in range(70)]
    return rows, spark.createDataFrame(rows, "user_id bigint, item_id bigint, at int")


@pytest.mark.parametrize("block", [1024, 16])
def test_cooccurrence_counts(spark, block):
    rows, df = interactions(spark)
    sets = {}
    for u, i, _ in rows:
        sets.setdefault(u, set()).add(i)
    want = {}
    for s in sets.values():
        for a in s:
            for b in s:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert {(r.item_a, r.item_b): r.users for r in R.cooccurrence(df, block).collect()} == want


def test_factor_search_equals_brute_force(spark):
    rows, df = interactions(spark)
    items, users = R.als_factors(df, rank=4, rounds=3)
    items, users = ({r[0]: np.array(r.vector) for r in d.collect()} for d in (items, users))
    seen = {(u, i) for u, i, _ in rows}
    got = {}
    for r in R.factor_recs(df, 5, rank=4, rounds=3).collect():
        got.setdefault(r.user_id, {})[r.item_id] = r.score
    hits = total = 0
    for u, v in users.items():
        best = sorted(((float(v @ w), -i) for i, w in items.items() if (u, i) not in seen), reverse=True)[:5]
        assert len(got[u]) == len(best) and not any((u, i) in seen for i in got[u])
        hits += sum(-i in got[u] for _, i in best)
        total += len(best)
    # Equal but for items whose scores are the same to six digits.
    assert hits >= 0.98 * total


def test_unseen_search_is_exact_and_deals_no_scores(spark, monkeypatch):
    """Barred pairs never leave a tile, ties go to the smaller id and k rows of a
    query leave each tile, whatever it has seen."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((700, 9))
    x[200:400] = x[100]
    x[5] = 0
    q = np.concatenate([rng.standard_normal((40, 9)), x[100:101], np.zeros((1, 9))])
    barred = {(int(a), int(b)) for a, b in zip(rng.integers(0, 42, 3000), rng.integers(0, 700, 3000))} | {(3, i) for i in range(697)}
    s = np.round(ivf.unit(q) @ ivf.unit(x).T, 6)
    s[tuple(np.array(sorted(barred)).T)] = -9
    want = {(i, int(j), r + 1) for i, row in enumerate(s) for r, j in enumerate(np.lexsort((np.arange(700), -row))[:5]) if row[j] > -9}
    out = spark.createDataFrame([*barred, (None, 1), (1, None), (99, 1), (1, 9999)], "query_id bigint, item_id bigint")
    for first, tiles in ((1024, {}), (16, {"tile_queries": 15, "tile_items": 300})):
        monkeypatch.setattr(topk, "ROWS", 8 if first == 16 else 256)
        monkeypatch.setattr(topk, "FIRST", first)
        monkeypatch.setattr(topk, "CHUNK", first)
        found = topk.tiled_unbarred(frame(spark, q, "query_id"), frame(spark, x), out, 5, **tiles)
        assert {(r.query_id, r.item_id, r["rank"]) for r in found.collect()} == want
    row, _, _ = topk.best_unbarred(ivf.unit(q), ivf.unit(x), tuple(np.array(sorted(barred)).T), 5)
    assert np.bincount(row).max() == 5


def test_unseen_search_sends_no_tile_twice(spark):
    """Nothing shuffled grows with queries times items: tiles meet where they are stored."""
    rng = np.random.default_rng(8)
    q, x = rng.standard_normal((30, 4)), rng.standard_normal((90, 4))
    found = topk.tiled_unbarred(frame(spark, q, "query_id"), frame(spark, x), spark.createDataFrame([(0, 1)], "query_id bigint, item_id bigint"), 3, tile_queries=5, tile_items=20)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "explode" not in plan and "Window" not in plan
    assert found.rdd.getNumPartitions() == 6 and found.count() == 90
