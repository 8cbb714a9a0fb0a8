"""Experiments, annotation, label selection and private aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sievework.functions.columns import h32, ratio, uniform
from sievework.functions.linear import least_squares, predicted
from sievework.functions.scan import number_rows
from sievework.operators.monitoring import drift
from sievework.session import cut


def assign(units: DataFrame, unit: str, salt: str, version: str, allocation: dict[str, int], excluded: Column | None = None) -> DataFrame:
    """Arm by salted hash over 10000 slots; the version is part of the salt.
    Excluded units get no arm. Allocation is configuration, in slots."""
    b = h32(F.lit(f"{salt}|{version}|"), F.col(unit)) % 10000
    arm, top = F.lit(None).cast("string"), 0
    for name, slots in allocation.items():
        arm = F.when(arm.isNull() & (b < top + slots), name).otherwise(arm)
        top += slots
    if excluded is not None:
        arm = F.when(~F.coalesce(excluded, F.lit(False)), arm)
    return units.withColumns({"bucket": b, "arm": arm, "assignment_version": F.lit(version)})


def exposed_outcomes(exposures: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcome rows with the first real exposure before them. exposures(unit,
    at, shadow), outcomes(unit, outcome_id, at, value)."""
    first = exposures.where("not shadow").groupBy("unit").agg(F.min("at").alias("exposed_at"))
    j = outcomes.join(first, "unit", "left")
    before = F.coalesce(F.col("exposed_at") < F.col("at"), F.lit(False))
    return j.select("unit", "outcome_id", "value", F.when(before, F.col("exposed_at")).alias("exposed_at"), before.alias("counted"))


# fixed values: chi-square critical values at 0.001 for 1..10 degrees of freedom
CHI2_001 = (10.828, 13.816, 16.266, 18.467, 20.515, 22.458, 24.322, 26.124, 27.877, 29.588)


def srm_test(assigned: DataFrame, arm: str, allocation: dict[str, int]) -> DataFrame:
    """Chi-square of observed against planned counts; ``biased`` means no winner
    may be named."""
    total = float(sum(allocation.values()))
    n = assigned.where(F.col(arm).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(arm) == a).alias(f"n_{a}") for a in allocation]
    )
    chi = reduce(lambda s, a: s + F.pow(F.col(f"n_{a}") - F.col("n") * (allocation[a] / total), F.lit(2.0)) / (F.col("n") * (allocation[a] / total)), allocation, F.lit(0.0))
    return n.withColumn("chi2", F.round(chi, 6)).withColumn("biased", F.col("chi2") > CHI2_001[len(allocation) - 2])


def effect_report(outcomes: DataFrame, arm: str, control: str, metrics: dict[str, dict]) -> DataFrame:
    """Per treatment arm and metric: difference, Welch interval, lift, practical
    and statistical significance; a guardrail metric that worsens past its limit fails.

    metrics: name -> {practical: x, guardrail: max allowed drop or None}."""
    long = outcomes.select(arm, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])))
    s = long.groupBy(arm, "metric").agg(F.avg("v").alias("mean"), F.var_samp("v").alias("var"), F.count("v").alias("n"))
    c = s.where(F.col(arm) == control).select("metric", F.col("mean").alias("cm"), F.col("var").alias("cv"), F.col("n").alias("cn"))
    j = s.where(F.col(arm) != control).join(c, "metric")
    diff, se = F.col("mean") - F.col("cm"), F.sqrt(F.col("var") / F.col("n") + F.col("cv") / F.col("cn"))
    pick = lambda k: reduce(lambda a, m: F.when(F.col("metric") == m, F.lit(metrics[m].get(k))).otherwise(a), metrics, F.lit(None))
    lo, hi = diff - 1.96 * se, diff + 1.96 * se
    guard = pick("guardrail").cast("double")
    return j.select(
        arm, "metric", "n", F.round(diff, 6).alias("diff"), F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"), F.round(ratio(diff, F.col("cm")), 6).alias("lift"),
        ((lo > 0) | (hi < 0)).alias("significant"), (F.abs(diff) >= pick("practical").cast("double")).alias("practical"),
        F.when(guard.isNull(), "not_guardrail").when(diff < -guard, "violated").otherwise("held").alias("guardrail"),
    )


def missingness_and_looks(outcomes: DataFrame, arm: str, day: str, value: str) -> DataFrame:
    """Per arm and look day: cumulative units, missing share, metric; every look
    before the last is marked as peeking. Days are summed first, so the frames
    run over days."""
    d = outcomes.groupBy(arm, day).agg(F.count(F.lit(1)).alias("u"), F.count_if(F.col(value).isNull()).alias("m"), F.coalesce(F.sum(value), F.lit(0.0)).alias("s"))
    w = Window.partitionBy(arm).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    last = outcomes.agg(F.max(day)).scalar()
    u, m, s = (F.sum(c).over(w) for c in "ums")
    return d.select(
        arm, day, u.alias("units"), F.round(m / u, 6).alias("missing"), F.round(ratio(s, u - m), 6).alias("metric"), (F.col(day) < last).alias("peek")
    )


def agreement(labels: DataFrame, pairs: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per declared annotator pair, overall, ambiguous items).

    labels(item, annotator, label), one label per item and annotator. A pair is
    two filtered sides joined on the item; Fleiss kappa uses counts only."""
    out = []
    for a, b in pairs:
        x = labels.where(F.col("annotator") == a).select("item", F.col("label").alias("x"))
        y = labels.where(F.col("annotator") == b).select("item", F.col("label").alias("y"))
        cells = x.join(y, "item").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
        tot = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
        marg = cells.select(F.col("x").alias("l"), F.col("n").alias("a"), F.lit(0).alias("b")).union(cells.select("y", F.lit(0), "n"))
        pe = marg.groupBy("l").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).agg(F.sum(F.col("a").cast("double") * F.col("b"))).scalar()
        po, e = F.col("same") / F.col("n"), pe / (F.col("n").cast("double") * F.col("n"))
        kappa = F.when(e == 1, F.lit(1.0)).otherwise((po - e) / (1 - e))
        out.append(tot.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", F.round(po, 6).alias("percent"), F.round(kappa, 6).alias("kappa")))
    cnt = labels.groupBy("item", "label").agg(F.count(F.lit(1)).alias("c"))
    per = cnt.groupBy("item").agg(F.sum("c").alias("r"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.max("c").alias("top"))
    rated = per.where("r > 1")
    share = cnt.join(rated.select("item"), "item", "left_semi").groupBy("label").agg(F.sum("c").alias("c"))
    total = share.agg(F.sum("c")).scalar()
    pe = share.agg(F.sum(F.pow(F.col("c") / total, F.lit(2.0)))).scalar()
    base = rated.agg(F.count(F.lit(1)).alias("items"), F.avg((F.col("sq") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("po"))
    prevalence = share.agg(F.max_by(F.round(F.col("c") / total, 6), F.struct("c", "label"))).scalar()
    overall = base.withColumn("pe", pe).select(
        "items", F.round("po", 6).alias("observed"), F.round(F.when(F.col("pe") == 1, F.lit(1.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("fleiss_kappa"), prevalence.alias("prevalence")
    )
    return reduce(DataFrame.unionByName, out), overall, per.where("top * 2 <= r").select("item", "r")


def adjudicate(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """Final label per item, next to every original label: the adjudicator's,
    else the strict majority, else pending. decisions(item, decided)."""
    cnt = labels.groupBy("item", "label").agg(F.count(F.lit(1)).alias("c"))
    per = cnt.groupBy("item").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.max("c").alias("top"), F.sum("c").alias("r"))
    f = per.join(decisions, "item", "left")
    strict = F.col("top") * 2 > F.col("r")
    f = f.select(
        "item", F.coalesce("decided", F.when(strict, F.col("major"))).alias("final"),
        F.when(F.col("decided").isNotNull(), "adjudicated").when(strict, "majority").otherwise("pending").alias("status"),
    )
    return labels.join(f, "item")


def select_for_labeling(pool: DataFrame, key: str, score: str, cluster: str, held_out: DataFrame, n: int, seed: str, version: str) -> DataFrame:
    """n items by each strategy (uncertainty, diversity, random); held-out items
    never enter. Diversity takes the same share of every cluster."""
    p = pool.join(held_out.select(key).distinct(), key, "left_anti").withColumn("_h", h32(F.lit(f"{seed}|"), F.col(key))).withColumn("_u", F.round(F.abs(F.col(score) - 0.5), 9))
    tag = lambda d, s: d.select(key, F.lit(s).alias("strategy"), F.lit(version).alias("selection_version"))
    unc = tag(p.orderBy("_u", key).limit(n), "uncertainty")
    rnd = tag(p.orderBy("_h", key).limit(n), "random")
    w = Window.partitionBy(cluster).orderBy("_h", key)
    div = p.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).orderBy("_r", cluster, key).limit(n)
    return unc.unionByName(tag(div, "diversity")).unionByName(rnd)


def label_rounds(df: DataFrame, order: Sequence[str], block: Column, correct: Column, size: int, strategy: str) -> DataFrame:
    """Cumulative metric after each round of ``size`` labels in the given order."""
    n = number_rows(df.withColumn("_ok", correct.cast("int")), order, block, "pos")
    r = n.groupBy(F.ceil(F.col("pos") / size).cast("int").alias("round")).agg(F.sum("_ok").alias("k"), F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return r.select(F.lit(strategy).alias("strategy"), "round", F.sum("c").over(w).alias("labels"), F.round(F.sum("k").over(w) / F.sum("c").over(w), 6).alias("metric"))


def label_efficiency(rounds: DataFrame, budget: int) -> DataFrame:
    """Area under metric against labels (trapezoid, per label) up to the budget."""
    w = Window.partitionBy("strategy").orderBy("labels")
    r = rounds.where(F.col("labels") <= budget).withColumn("_pl", F.lag("labels").over(w)).withColumn("_pm", F.lag("metric").over(w))
    area = F.sum((F.col("labels") - F.col("_pl")) * (F.col("metric") + F.col("_pm")) / 2)
    return r.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("rounds"), F.round(ratio(area, F.max("labels") - F.min("labels")), 6).alias("auc"), F.round(F.max_by("metric", "labels"), 6).alias("final_metric")
    )


def synthetic_utility(real: DataFrame, syn: DataFrame, numeric: Sequence[str], group: str, target: Column, rare: str, rare_share: float) -> DataFrame:
    """(measure, subject, value): marginal distances, correlation gap, rare-value
    coverage, subgroup rate gap, schema match."""
    item = lambda m, s, v: F.struct(F.lit(m).alias("measure"), s.alias("subject"), F.round(v, 6).alias("value"))
    d = drift(real, syn, numeric)
    out = d.select(F.inline(F.array(item("ks", F.col("column"), F.col("ks")), item("psi", F.col("column"), F.col("psi")))))
    pairs = [(a, b) for i, a in enumerate(numeric) for b in list(numeric)[i + 1 :]]
    both = real.select(F.lit(0).alias("side"), *numeric).unionByName(syn.select(F.lit(1).alias("side"), *numeric))
    side = lambda c, s: F.when(F.col("side") == s, F.col(c))
    gaps = [item("correlation_gap", F.lit(f"{a}~{b}"), F.abs(F.corr(side(a, 0), side(b, 0)) - F.corr(side(a, 1), side(b, 1)))) for a, b in pairs]
    out = out.unionByName(both.agg(F.array(*gaps).alias("g")).select(F.inline("g")))
    # Counts by group and rare value serve the coverage and the rates, so each table is read once for both.
    counted = lambda df: cut(df.groupBy(F.col(group).alias("g"), F.col(rare).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.count(target).alias("m"), F.sum(target.cast("double")).alias("t")))
    cr, cs = counted(real), counted(syn)
    total = cr.agg(F.sum("n")).scalar()
    rv = cr.groupBy("r").agg(F.sum("n").alias("n")).where(F.col("n") < rare_share * total)
    hit = rv.join(cs.select("r").distinct().withColumn("_s", F.lit(True)), "r", "left")
    out = out.unionByName(hit.agg(item("rare_coverage", F.lit(rare), ratio(F.count_if("_s"), F.count(F.lit(1)))).alias("r")).select("r.*"))
    rate = lambda df, n: df.groupBy("g").agg(F.try_divide(F.sum("t"), F.sum("m")).alias(n))
    sub = rate(cr, "a").join(rate(cs, "b"), "g", "full_outer")
    out = out.unionByName(sub.select(F.lit("subgroup_gap").alias("measure"), F.col("g").cast("string").alias("subject"), F.round(F.abs(F.col("a") - F.col("b")), 6).alias("value")))
    same = float({(f.name, f.dataType.simpleString()) for f in real.schema} == {(f.name, f.dataType.simpleString()) for f in syn.schema})
    return out.unionByName(real.sparkSession.createDataFrame([("schema_match", "all", same)], "measure string, subject string, value double"))


def train_on_synthetic(real: DataFrame, syn: DataFrame, features: Sequence[str], target: Column, held_out: Column, ridge: float = 0.0) -> DataFrame:
    """(train, test, n, accuracy, gap): linear classifiers fitted on real and on
    generated rows, both tested on the real rows of ``held_out`` and on all
    generated rows; ``gap`` is what a test loses against training on the other's
    own kind. All fits are one aggregation of products (least squares for the
    target as 0 or 1, positive from one half on)."""
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    shaped = lambda d, name, held: d.select(F.lit(name).alias("set"), x.alias("x"), target.cast("double").alias("y"), held.alias("held"))
    rows = shaped(real, "real", held_out).unionByName(shaped(syn, "synthetic", F.lit(False)))
    w = least_squares(rows.where("not held"), ["set"], "x", "y", len(features) + 1, ridge).select(F.col("set").alias("train"), "w")
    # Two small rows of weights meet every test row.
    tests = rows.where("held or set = 'synthetic'").withColumn("train", F.explode(F.array(F.lit("real"), F.lit("synthetic")))).join(F.broadcast(w), "train")
    hit = ((predicted("x", "w") >= 0.5).cast("double") == F.col("y")).cast("double")
    out = tests.groupBy("train", F.col("set").alias("test")).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))
    own = out.where("train = test").select("test", F.col("accuracy").alias("_own"))
    return out.join(own, "test").select("train", "test", "n", F.round("accuracy", 6).alias("accuracy"), F.round(F.col("_own") - F.col("accuracy"), 6).alias("gap"))


def bounded_contributions(df: DataFrame, user: str, order: str, value: Column, bound: int, low: float, high: float, seed: str) -> DataFrame:
    """At most ``bound`` seeded rows per user, values clipped. The row limit is
    applied before the shuffle, so a heavy user is cut down at the source."""
    w = Window.partitionBy(user).orderBy(h32(F.lit(f"{seed}|"), F.col(order)), order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= bound).drop("_r").withColumn("clipped", F.greatest(F.lit(low), F.least(F.lit(high), value)))


def private_aggregate(bounded: DataFrame, key: str, eps: float, bound: int, low: float, high: float, seed: str) -> DataFrame:
    """Noisy count and sum per key with Laplace noise from a seeded hash, half of
    eps each, beside the exact values for a utility check."""
    g = bounded.groupBy(key).agg(F.count(F.lit(1)).alias("exact_n"), F.sum("clipped").alias("exact_sum"))

    def laplace(tag: str, scale: float) -> Column:
        u = uniform(F.lit(f"{seed}|{tag}|"), F.col(key)) - 0.5
        return -F.lit(scale) * F.signum(u) * F.ln(1 - 2 * F.abs(u))

    span = max(abs(low), abs(high))
    return g.select(
        key, "exact_n", F.round("exact_sum", 6).alias("exact_sum"), F.round(F.col("exact_n") + laplace("n", 2 * bound / eps), 6).alias("noisy_n"),
        F.round(F.col("exact_sum") + laplace("s", 2 * bound * span / eps), 6).alias("noisy_sum"), F.lit(eps).alias("epsilon"),
    )


def epsilon_ledger(spends: DataFrame, dataset: str, at: str, eps: str, limit: float) -> DataFrame:
    """Epsilon spent after each request, in time order; a request that would pass
    the limit is refused and costs nothing.

    What is left decides each next request, so a dataset's requests are read one
    after the other: sorted by Spark, with one number kept for the dataset."""
    schema = T.StructType([*spends.schema.fields, T.StructField("spent", T.DoubleType()), T.StructField("refused", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, spent = object(), 0.0
        for b in batches:
            totals, refused = [], []
            for d, e in zip(b[dataset].tolist(), b[eps].tolist()):
                if d != key:
                    key, spent = d, 0.0
                over = round(spent + e, 9) > limit
                spent = spent if over else round(spent + e, 9)
                totals.append(spent)
                refused.append(over)
            yield b.assign(spent=totals, refused=refused)

    return spends.repartition(dataset).sortWithinPartitions(dataset, at).mapInPandas(run, schema)


def weak_labels(df: DataFrame, key: str, functions: Sequence[tuple[str, Column]], truth: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(label per row, quality per function). Each function is a column of 0, 1
    or null; a tie or no vote gives no label."""
    votes = df.select(key, F.col(truth).alias("_t"), *[c.cast("int").alias(f"_f{i}") for i, (_, c) in enumerate(functions)])
    arr = F.array(*[F.col(f"_f{i}") for i in range(len(functions))])
    cast = F.filter(arr, lambda x: x.isNotNull())
    ones, n = F.aggregate(cast, F.lit(0), lambda a, x: a + x), F.size(cast)
    label = F.when(ones * 2 > n, 1).when((ones * 2 < n) & (n > 0), 0)
    rows = votes.select(key, n.alias("votes"), label.alias("label"), ((ones > 0) & (ones < n)).alias("conflict"), F.lit(version).alias("method_version"))
    total = F.count(F.lit(1))
    stats = []
    for i, (name, _) in enumerate(functions):
        me = F.col(f"_f{i}")
        clash = me.isNotNull() & (ones > 0) & (ones < n)
        stats.append(
            F.struct(
                F.lit(name).alias("function"), F.round(F.count(me) / total, 6).alias("coverage"), F.round(F.count_if(clash) / total, 6).alias("conflict"),
                F.round(F.avg((me == F.col("_t")).cast("double")), 6).alias("accuracy"),
            )
        )
    return rows, votes.agg(F.array(*stats).alias("s")).select(F.inline("s"))
