"""Block scans and quantiles against pandas, with one key holding most rows."""

import random

import pandas as pd
from pyspark.sql import functions as F

from sievework.functions.graphs import components
from sievework.functions.scan import exact_quantiles, last_known, number_rows, previous, running


def frame(spark):
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 6), i, round(rng.uniform(0, 50), 2) if rng.random() < 0.9 else None) for i in range(700)]
    rng.shuffle(rows)
    return pd.DataFrame(rows, columns=["k", "t", "v"]), spark.createDataFrame(rows, "k long, t long, v double").repartition(7)


def test_running_equals_cumulative(spark):
    p, d = frame(spark)
    out = running(d, ["k"], ["t"], F.floor(F.col("t") / 13), s=("sum", F.col("v")), n=("count", F.lit(1)), m=("max", F.col("v"))).toPandas().sort_values("t")
    p = p.sort_values("t")
    g = p.groupby("k")["v"]
    assert (out["s"].round(6).tolist()) == p["v"].fillna(0).groupby(p["k"]).cumsum().round(6).tolist()
    assert out["n"].tolist() == (p.groupby("k").cumcount() + 1).tolist()
    want = g.cummax().groupby(p["k"]).ffill()
    assert out["m"].fillna(-1).tolist() == want.fillna(-1).tolist()


def test_previous_and_last_known(spark):
    p, d = frame(spark)
    p = p.sort_values("t")
    a = previous(d, ["k"], ["t"], F.floor(F.col("t") / 13), b=F.col("v")).toPandas().sort_values("t")
    assert a["b"].fillna(-1).tolist() == p.groupby("k")["v"].shift().fillna(-1).tolist()
    b = last_known(d, ["k"], ["t"], F.floor(F.col("t") / 13), b=F.col("v")).toPandas().sort_values("t")
    assert b["b"].fillna(-1).tolist() == p.groupby("k")["v"].ffill().fillna(-1).tolist()


def test_number_rows(spark):
    _, d = frame(spark)
    out = number_rows(d, ["t"], F.floor(F.col("t") / 13)).toPandas().sort_values("t")
    assert out["pos"].tolist() == list(range(1, 701))


def test_exact_quantiles(spark):
    p, d = frame(spark)
    out = exact_quantiles(d, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).toPandas().set_index("k").sort_index()
    for name, q in (("a", 0.1), ("b", 0.5), ("c", 0.99)):
        assert out[name].round(9).tolist() == p.groupby("k")["v"].quantile(q).round(9).tolist()
    one = exact_quantiles(d, [], "v", {"m": 0.5}).first()["m"]
    assert round(one, 9) == round(p["v"].median(), 9)


def test_quantiles_of_heavy_tails_and_ties(spark):
    values = [1e12, -1e12] + [float(i % 7) for i in range(900)] + [float(i) ** 3 for i in range(300)]
    d = spark.createDataFrame([(v,) for v in values], "v double").repartition(6)
    probs = {"a": 0.01, "b": 0.5, "c": 0.999, "d": 1.0}
    got = exact_quantiles(d, [], "v", probs, accuracy=100).first()
    s = pd.Series(values)
    assert [round(got[n], 6) for n in probs] == [round(s.quantile(q), 6) for q in probs.values()]
    one = exact_quantiles(d.limit(1).selectExpr("5.0D as v"), [], "v", {"m": 0.3}).first()["m"]
    assert one == 5.0


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 140)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in nodes}


def test_many_blocks_in_two_levels(spark, monkeypatch):
    from sievework.functions import scan

    monkeypatch.setattr(scan, "GROUP", 3)
    p, d = frame(spark)
    p = p.sort_values("t")
    for block in (F.floor(F.col("t") / 5), F.struct(F.floor(F.col("t") / 50), F.floor(F.col("t") / 5))):
        out = running(d, [], ["t"], block, inclusive=False, s=("sum", F.col("v")), n=("count", F.lit(1)), m=("max", F.col("v"))).toPandas().sort_values("t")
        assert out["s"].round(6).tolist() == p["v"].fillna(0).cumsum().shift(fill_value=0).round(6).tolist()
        assert out["n"].tolist() == list(range(700))
        assert out["m"].fillna(-1).tolist() == p["v"].cummax().ffill().shift().fillna(-1).tolist()


def test_quantiles_of_few_keys_sort_no_rows(spark):
    """Brackets go to the rows: neither joined nor summed rows are dealt by key."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(3000).selectExpr("id % 3 AS g", "double(id) AS v")
        got = exact_quantiles(rows, ["g"], "v", {"m": 0.5})
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "SortMergeJoin" not in plan
        assert {r.g: r.m for r in got.collect()} == {0: 1498.5, 1: 1499.5, 2: 1500.5}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
