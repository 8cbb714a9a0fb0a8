"""Outliers, isolation scores, effects, graph features and scaling fits."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from sievework.functions.columns import h32, ratio, seconds, uniform
from sievework.functions.scan import exact_quantiles
from sievework.session import cut, small


def robust_outliers(df: DataFrame, col: str, group: str, limit: float = 3.5) -> DataFrame:
    """0.6745 * (x - median) / MAD per group. Where MAD is 0 a value off the
    median has no finite score and is an outlier."""
    med = small(cut(exact_quantiles(df, [group], col, {"_med": 0.5})))
    d = df.join(med, group).withColumn("_dev", F.abs(F.col(col) - F.col("_med")))
    mad = small(cut(exact_quantiles(d, [group], "_dev", {"_mad": 0.5})))
    d = d.join(mad, group)
    score = F.when(F.col("_mad") > 0, 0.6745 * (F.col(col) - F.col("_med")) / F.col("_mad")).when(F.col("_dev") == 0, 0.0)
    return d.withColumn("score", F.round(score, 6)).withColumn("outlier", F.coalesce(F.abs("score") > limit, F.lit(True))).drop("_dev", "_med", "_mad")


def cut_fraction(seed: str, tree: int, node: int, what: str) -> float:
    """Seeded fraction in [0, 1) for one tree node."""
    return int(hashlib.md5(f"{seed}|{tree}|{node}|{what}".encode()).hexdigest()[:8], 16) / 4294967296


def _leaves(seed: str, trees: int, depth: int, size: int):
    """Arrow function: leaf ids of every tree, walked level by level through flat
    tables of axes and cuts (node 1 is a root, 2n and 2n + 1 are its children)."""
    nodes = 2**depth
    axis = np.array([[int(cut_fraction(seed, t, n, "axis") * size) if n else 0 for n in range(nodes)] for t in range(trees)])
    cuts = np.array([[cut_fraction(seed, t, n, "cut") if n else 0.0 for n in range(nodes)] for t in range(trees)])

    @pandas_udf(ArrayType(IntegerType()))
    def run(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        x = np.stack(batch.to_numpy()).astype(float)
        out = np.empty((len(x), trees), np.int32)
        rows = np.arange(len(x))
        for t in range(trees):
            node = np.ones(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + (x[rows, axis[t, node]] > cuts[t, node])
            out[:, t] = node + t * 2 * nodes
        return pd.Series(list(out), index=batch.index)

    return run


def isolation_scores(df: DataFrame, cols: Sequence[str], trees: int, depth: int, seed: str) -> DataFrame:
    """Isolation score from random axis cuts: shorter expected path, higher score.

    The cut tables are small and seeded; leaf masses (trees * 2^depth counts)
    come back as one scalar array, so the data is scanned twice and never moved."""
    span = df.agg(F.struct(F.count(F.lit(1)).alias("_n"), *[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in cols])).scalar()
    norm = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_span.{c}.a"), F.col(f"_span.{c}.b") - F.col(f"_span.{c}.a")), F.lit(0.0))
    src = df.withColumn("_span", span).select(*df.columns, F.col("_span._n").cast("double").alias("_total"), *[norm(c).alias(f"_x{i}") for i, c in enumerate(cols)])
    x = F.array(*[F.col(f"_x{i}") for i in range(len(cols))])
    src = src.select(*df.columns, "_total", _leaves(seed, trees, depth, len(cols))(x).alias("_leaf"))
    mass = src.select(F.explode("_leaf").alias("_l")).groupBy("_l").agg(F.count(F.lit(1)).alias("_n"))
    c = lambda n: F.when(n > 2, 2 * (F.ln(n - 1) + 0.5772156649) - 2 * (n - 1) / n).when(n == 2, 1.0).otherwise(0.0)
    length = mass.select("_l", (depth + c(F.col("_n").cast("double"))).alias("_d"))
    # Leaf ids are dense, so the lengths are an array looked up by place.
    places = F.sequence(F.lit(0), F.lit(trees * 2 ** (depth + 1) - 1))
    table = length.agg(F.map_from_entries(F.collect_list(F.struct("_l", "_d"))).alias("m")).select(F.transform(places, lambda i: F.element_at("m", i))).scalar()
    path = F.aggregate("_leaf", F.lit(0.0), lambda acc, leaf: acc + F.get(F.col("_mass"), leaf)) / trees
    out = src.withColumn("_mass", table)
    return out.withColumn("score", F.round(F.pow(F.lit(2.0), -path / c(F.col("_total"))), 6)).drop("_leaf", "_mass", "_total")


def anomaly_eval(df: DataFrame, score: str, truth: str, ts: str, tune: Column, grid: Sequence[float]) -> DataFrame:
    """Precision and recall per threshold on both splits in one pass; ``chosen``
    marks the best F1 of the tune split; delay is first alarm minus first truth
    on the test split."""
    src = df.withColumn("_tune", tune)
    rows = src.select("*", F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("threshold"))
    hit, real = F.col(score) >= F.col("threshold"), F.col(truth) == 1
    m = rows.groupBy("threshold", F.when(F.col("_tune"), "tune").otherwise("test").alias("split")).agg(
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"),
        F.min(F.when(hit & real, F.col(ts))).alias("_alarm"), F.min(F.when(real, F.col(ts))).alias("_first"),
    )
    m = m.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    best = m.where("split = 'tune'").agg(F.max_by("threshold", F.struct("f1", -F.col("threshold")))).scalar()
    return m.withColumn("_best", best).select(
        "threshold", "split", "tp", "fp", "fn", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"),
        F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"), F.round("f1", 6).alias("f1"),
        (F.col("threshold") == F.col("_best")).alias("chosen"),
        F.when(F.col("split") == "test", F.round(seconds(F.col("_alarm")) - seconds(F.col("_first")), 3)).alias("delay_s"),
    )


def treatment_effects(df: DataFrame, treat: str, outcome: str, stratum: str, covariate: str) -> DataFrame:
    """(method, effect): naive, stratified, inverse propensity by stratum, and
    covariate-adjusted regression; all from one pass of per-stratum sums."""
    t, y, x = F.col(treat).cast("double"), F.col(outcome).cast("double"), F.col(covariate).cast("double")
    s = df.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n"), F.sum(t).alias("n1"), F.sum(t * y).alias("y1"), F.sum((1 - t) * y).alias("y0"),
        F.sum(y).alias("sy"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(x * t).alias("sxt"),
    )
    n1, n0, n = F.col("n1"), F.col("n") - F.col("n1"), F.col("n")
    diff = F.when((n1 > 0) & (n0 > 0), F.col("y1") / n1 - F.col("y0") / n0)
    a = s.agg(
        F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum("y1").alias("y1"), F.sum("y0").alias("y0"), F.sum("sy").alias("sy"),
        F.sum("sx").alias("sx"), F.sum("sxx").alias("sxx"), F.sum("sxy").alias("sxy"), F.sum("sxt").alias("sxt"),
        (F.sum(diff * n) / F.sum(F.when(diff.isNotNull(), n))).alias("strat"),
        (F.sum(F.when(n1 > 0, F.col("y1") * n / n1)) - F.sum(F.when(n0 > 0, F.col("y0") * n / n0))).alias("ipw"),
    )
    stt = F.col("n1") - F.col("n1") * F.col("n1") / F.col("n")
    sxx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    stx = F.col("sxt") - F.col("sx") * F.col("n1") / F.col("n")
    sty = F.col("y1") - F.col("n1") * F.col("sy") / F.col("n")
    sxy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    items = {
        "naive": F.col("y1") / F.col("n1") - F.col("y0") / (F.col("n") - F.col("n1")), "stratified": F.col("strat"),
        "inverse_propensity": F.col("ipw") / F.col("n"), "regression": (sty * sxx - sxy * stx) / (stt * sxx - stx * stx),
    }
    return a.select(F.inline(F.array(*[F.struct(F.lit(k).alias("method"), F.round(v, 6).alias("effect")) for k, v in items.items()])))


def refute_effect(df: DataFrame, key: str, treat: str, outcome: str, stratum: str, covariate: str, seed: str) -> DataFrame:
    """Stratified effect under placebo treatment, an added random cause and a
    random subset; the first should vanish and the others stay."""
    runs = {
        "placebo": df.withColumn(treat, (uniform(F.lit(f"{seed}|p|"), F.col(key)) < 0.5).cast("int")),
        "random_cause": df.withColumn(stratum, F.concat(F.col(stratum).cast("string"), F.lit("|"), (h32(F.lit(f"{seed}|c|"), F.col(key)) % 2).cast("string"))),
        "subset": df.where(uniform(F.lit(f"{seed}|s|"), F.col(key)) < 0.8),
    }
    out = None
    for name, d in runs.items():
        one = treatment_effects(d, treat, outcome, stratum, covariate).where("method = 'stratified'").select(F.lit(name).alias("refuter"), "effect")
        out = one if out is None else out.unionByName(one)
    return out


def neighbour_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per hub: degree, label rate over its train neighbours only, and edges
    that touch a test node. edges(hub, node), nodes(node, label, split)."""
    e = edges.select("hub", "node").distinct().join(nodes, "node")
    train = F.col("split") == "train"
    return e.groupBy("hub").agg(
        F.count(F.lit(1)).alias("degree"), F.round(F.avg(F.when(train, F.col("label").cast("double"))), 6).alias("label_rate"), F.count_if(~train).alias("test_edges")
    )


def graph_gain(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Test accuracy of a majority rule against the mean neighbour rate rule."""
    feats = neighbour_features(edges, nodes)
    e = edges.select("hub", "node").distinct().join(feats, "hub")
    score = e.groupBy("node").agg(F.avg("label_rate").alias("rate"))
    base = nodes.where("split = 'train'").agg(F.avg(F.col("label").cast("double"))).scalar()
    t = nodes.where("split = 'test'").join(score, "node", "left").withColumn("_base", base)
    ok = lambda c: F.avg((F.coalesce((c >= F.col("_base")).cast("int"), F.lit(0)) == F.col("label")).cast("double"))
    return t.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(((F.col("_base") >= 0.5).cast("int") == F.col("label")).cast("double")), 6).alias("plain_accuracy"),
        F.round(ok(F.round("rate", 9)), 6).alias("graph_accuracy"),
    )


def scaling_fit(runs: DataFrame, family: str, compute: str, loss: str) -> DataFrame:
    """Log-log line of loss against compute per family with its evidence range."""
    x, y = F.ln(F.col(compute)), F.ln(F.col(loss))
    src = runs.where((F.col(compute) > 0) & (F.col(loss) > 0)).select(family, compute, x.alias("_x"), y.alias("_y"))
    n = F.count(F.lit(1))
    return src.groupBy(family).agg(
        n.alias("n"), F.round(F.regr_slope("_y", "_x"), 6).alias("slope"), F.round(F.regr_intercept("_y", "_x"), 6).alias("intercept"),
        F.round(F.regr_r2("_y", "_x"), 6).alias("r2"),
        F.round((F.regr_syy("_y", "_x") - F.pow(F.regr_sxy("_y", "_x"), F.lit(2.0)) / F.regr_sxx("_y", "_x")) / (n - 2), 6).alias("residual_variance"),
        F.min(compute).alias("from_compute"), F.max(compute).alias("to_compute"),
    )
