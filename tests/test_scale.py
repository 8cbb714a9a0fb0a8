"""Few keys with very many rows do not make few tasks; tables are read once."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sievework.operators import anomaly as A, experiments as X, knowledge as G, recommend as R
from sievework.session import cut, dealt


@pytest.fixture
def no_size_check(spark):
    """Tables of these tests are small, so Spark alone would broadcast them."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_outliers_deal_no_rows_by_group(spark, no_size_check):
    rows = spark.range(300).selectExpr("id % 3 AS g", "double(id) AS v")
    out = A.robust_outliers(rows, "v", "g")
    assert "SortMergeJoin" not in plan(out) and out.count() == 300


def test_weights_go_to_the_test_rows(spark, no_size_check):
    rows = spark.range(200).selectExpr("double(id) AS q", "id > 100 AS t", "id % 2 = 0 AS held")
    out = X.train_on_synthetic(rows, rows.drop("held"), ["q"], rows["t"], rows["held"])
    assert "BroadcastHashJoin" in plan(out)
    assert {(r.train, r.test): r.n for r in out.collect()} == {("real", "real"): 100, ("real", "synthetic"): 200, ("synthetic", "real"): 100, ("synthetic", "synthetic"): 200}


def test_utility_reads_each_table_few_times(spark, sf):
    got = entry.queries()["X10_synthetic_utility"](spark, sf)
    assert plan(got).count("FileScan") <= 4


def test_graph_diff_tasks_grow_in_number(spark, sf):
    rows = dealt(spark.range(1000).selectExpr("id % 7 AS a", "id AS b"), ["a", "b"], rows=50)
    assert rows.rdd.getNumPartitions() == 20
    assert "REPARTITION_BY_NUM" in plan(entry.queries()["R27_graph_diff"](spark, sf))


def test_hops_deal_no_edges_by_group_or_hub(spark, no_size_check, monkeypatch):
    plans = []
    monkeypatch.setattr(G, "cut", lambda d: plans.append(plan(d)) or cut(d))
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "x", 0), ("c", "d", 1)], "src string, dst string, grp int")
    got = G.k_hop(edges, spark.createDataFrame([("a",)], "seed string"), 2, edges.where("grp = 0").select("grp").distinct())
    assert {(r.node, r.depth, r.path) for r in got.collect()} == {("b", 1, "a>b"), ("c", 2, "a>b>c")}
    anti = [p for p in plans if "LeftAnti" in p and "grp" in p]
    assert anti and all("SortMergeJoin [grp" not in p for p in anti)
    assert not any("SortMergeJoin [node" in p and "Inner" in p for p in plans)


def test_postings_hold_few_words_at_a_time(spark, monkeypatch):
    """Parts of a segment give the scores of the whole."""
    from sievework.functions import postings as P
    from sievework.operators import retrieval
    from sievework.session import scratch_path

    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 11}" for j in range(1 + i % 9))) for i in range(60)]
    items, asked = spark.createDataFrame(rows, "item_id bigint, text string"), spark.createDataFrame([(1, "w1 w2"), (2, "w5 w9 w0")], "query_id bigint, text string")
    found = lambda: {(r.query_id, r.item_id, r["rank"]): r.score for r in retrieval.bm25_topk(asked, items, 5).collect()}
    whole = found()
    monkeypatch.setattr(P, "PART_WORDS", 12)
    stored = P.build_postings(items, retrieval.tokens(items["text"]), scratch_path(spark, "parts"), segment_rows=60)
    assert stored.rows.where("aggregate(counts, 0, (a, c) -> a + c) > 12 + 9").count() == 0
    several = stored.rows.groupBy("segment", "term").count().where("count > 1").count()
    assert found() == whole and len(whole) == 10 and several > 0


def test_pair_counts_leave_in_small_frames():
    pairs = np.random.default_rng(4).integers(0, 9, (500, 2))
    held = [pairs[:200], pairs[200:]]
    frames = list(R._pair_frames(held, rows=20))
    assert held == [] and max(len(f) for f in frames) == 20
    got = {(int(a), int(b)): int(n) for f in frames for a, b, n in f.itertuples(index=False)}
    assert got == Counter((int(a), int(b)) for a, b in pairs)


def test_elements_and_payloads_are_not_sent_whole(spark, monkeypatch):
    """However small Spark guesses a table of lists to be."""
    from sievework.functions import links as L

    plans = []
    monkeypatch.setattr(L, "cut", lambda d: plans.append(plan(d)) or cut(d))
    sets = {1: range(20), 2: range(1, 20), 3: range(50, 70), 4: range(51, 71), 5: range(90, 95)}
    items = cut(spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "id bigint, payload array<bigint>"))
    blocks = L.rare_blocks(items, 0.8)
    assert "Broadcast" not in plan(blocks)
    same = lambda a, b: F.size(F.array_intersect(a, b)) >= 0.8 * F.size(F.array_union(a, b))
    got = L.complete_links(blocks, items, same).collect()
    assert {(r.leader, r.member) for r in got} == {(1, 2), (3, 4)}
    rated = [p for p in plans if "array_intersect" in p]
    assert len(rated) == 2 and all(p.count("SortMergeJoin") == 2 for p in rated)


def test_rare_elements_alone_are_dealt(spark, monkeypatch):
    """The sets are never exploded, whatever the sketch mixes up."""
    from sievework.functions import links as L

    rng = np.random.default_rng(8)
    sets = [sorted({int(x) for x in rng.choice(90, 20)}) for _ in range(30)]
    sets += [s[1:] for s in sets[:15]] + [s[:-1] + [200 + i] for i, s in enumerate(sets[10:25])] + [[]]
    items = cut(spark.createDataFrame(list(enumerate(sets)), "id bigint, payload array<bigint>"))
    for bits, parts in ((21, 64), (3, 4)):
        counts = L.element_counts(items, bits, parts)
        assert counts.sum() == sum(map(len, sets)) and len(counts) == 1 << bits
        monkeypatch.setattr(L, "element_counts", lambda d, b, n=counts: n)
        made = L.rare_blocks(items, 0.8, bits)
        monkeypatch.undo()
        assert "Generate explode" not in plan(made)
        blocks = {}
        for r in made.collect():
            blocks.setdefault(r.id, set()).add(r.block)
        assert all(len(b) <= len(sets[i]) - np.ceil(0.8 * len(sets[i])) + 1 for i, b in blocks.items())
        near = [(i, j) for i in range(len(sets)) for j in range(i) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]}) > 0]
        assert near and all(blocks[i] & blocks[j] for i, j in near)


def test_merges_store_words_and_pair_counts_only(spark, monkeypatch):
    from sievework.operators import tokenizer as B

    kept = []
    monkeypatch.setattr(B, "cut", lambda d: kept.append(d.columns) or cut(d))
    text = spark.createDataFrame([("abab abc bcd cdcd xyx xyx yx abab",)], "text string")
    assert B.train_bpe(text, "text", 5, every=1)[0] == ("a", "b", 5)
    assert len(kept) > 3 and {tuple(c) for c in kept} == {("word", "n"), ("a", "b", "c")}
