"""Model metrics, gates, slices, intervals and model fitting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from sievework.functions.columns import h32, ratio, uniform
from sievework.functions.scan import running


def majority_baseline(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Most frequent train class (ties to the greater label) and test accuracy."""
    counts = train.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max_by(target, F.struct("n", target))).scalar()
    return test.withColumn("_m", top).agg(
        F.max("_m").alias("majority_class"), F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col(target) == F.col("_m")).cast("double")), 6).alias("accuracy")
    )


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [
        F.round(ratio(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
    ]


def classification_metrics(df: DataFrame, score: str, pred: str, truth: str, blocks: int = 1000) -> DataFrame:
    """One row: confusion counts, accuracy, precision, recall, F1 and rank AUC.

    AUC comes from counts per distinct score, scanned in score blocks, so the
    rows are never sorted globally. Scores are in [0, 1]."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    conf = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    per = df.groupBy(F.col(score).alias("_s")).agg(F.count_if(t).alias("_p"), F.count_if(~t).alias("_n"))
    cum = running(per, [], ["_s"], F.floor(F.col("_s") * blocks).cast("int"), inclusive=False, _below=("sum", F.col("_n")))
    auc = cum.agg(ratio(F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2.0)), F.sum("_p") * F.sum("_n"))).scalar()
    return conf.select("tp", "fp", "fn", "tn", *rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))).withColumn("auc", F.round(auc, 6))


def calibration_bins(df: DataFrame, score: str, truth: str, n: int) -> DataFrame:
    """Per bin: count, mean score, observed rate; each row carries ECE and Brier."""
    b = F.least(F.floor(F.col(score) * n), F.lit(n - 1)).cast("int")
    bins = df.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(truth).alias("observed"),
        F.sum((F.col(score) - F.col(truth)) * (F.col(score) - F.col(truth))).alias("_sq"),
    )
    total = bins.agg(
        F.struct((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("observed"))) / F.sum("n")).alias("ece"), (F.sum("_sq") / F.sum("n")).alias("brier"))
    ).scalar()
    return bins.withColumn("_t", total).select(
        "bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("observed", 6).alias("observed"),
        F.round("_t.ece", 6).alias("ece"), F.round("_t.brier", 6).alias("brier"),
    )


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = ratio(hits, n)
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def slice_metrics(df: DataFrame, slices: Sequence[str], correct: Column, min_n: int) -> DataFrame:
    """Accuracy with its Wilson interval per declared slice (one grouping-sets
    pass); a slice under ``min_n`` is suppressed; the worst scored slice is marked."""
    src = df.withColumn("_ok", correct.cast("int"))
    sets = [[], *[[s] for s in slices]]
    g = src.groupingSets(sets, *slices).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.sum("_ok").alias("hits"))
    kind, value = F.lit("all"), F.lit("all")
    for i, s in enumerate(slices):
        here = F.col("_g") == (2 ** len(slices) - 1) - 2 ** (len(slices) - 1 - i)
        kind, value = F.when(here, s).otherwise(kind), F.when(here, F.col(s).cast("string")).otherwise(value)
    lo, hi = wilson(F.col("hits"), F.col("n"))
    enough = F.col("n") >= min_n
    scored = g.select(
        kind.alias("slice"), value.alias("value"), "n", (~enough).alias("suppressed"),
        F.when(enough, F.round(F.col("hits") / F.col("n"), 6)).alias("accuracy"),
        F.when(enough, F.round(lo, 6)).alias("low"), F.when(enough, F.round(hi, 6)).alias("high"),
    )
    worst = scored.where("slice <> 'all' and not suppressed").agg(F.min(F.struct("accuracy", "slice", "value"))).scalar()
    return scored.withColumn("_w", worst).withColumn(
        "worst", F.coalesce((F.col("slice") == F.col("_w.slice")) & (F.col("value") == F.col("_w.value")), F.lit(False))
    ).drop("_w")


def metric_gate(metrics: DataFrame, minimums: dict[str, float], version: str) -> DataFrame:
    """Decision per (subject, metric): allow only when the value reaches its
    minimum; a missing, unreported or NaN value denies.

    metrics(subject, metric, value); the minimums are configuration."""
    items = [F.struct(F.lit(m).alias("metric"), F.lit(float(v)).alias("minimum")) for m, v in sorted(minimums.items())]
    per = metrics.where(F.col("metric").isin(*minimums)).groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("_v"))
    per = metrics.select("subject").distinct().join(per, "subject", "left")
    rows = per.select("subject", "_v", F.explode(F.array(*items)).alias("_t"))
    rows = rows.select("subject", F.col("_t.metric").alias("metric"), F.try_element_at("_v", F.col("_t.metric")).alias("value"), F.col("_t.minimum").alias("minimum"))
    ok = F.coalesce((F.col("value") >= F.col("minimum")) & ~F.isnan("value"), F.lit(False))
    reason = F.when(ok, "reached").when(F.col("value").isNull() | F.isnan("value"), "missing").otherwise("below_minimum")
    return rows.select("*", F.lit(version).alias("threshold_version"), F.when(ok, "allow").otherwise("deny").alias("decision"), reason.alias("reason"))


def compare_candidates(base: DataFrame, cand: DataFrame, keys: Sequence[str], value: str, required_gain: float) -> DataFrame:
    """Delta per key, regression flag, and whether the required gain is met."""
    j = base.select(*keys, F.col(value).alias("base")).join(cand.select(*keys, F.col(value).alias("cand")), list(keys), "full_outer")
    delta = F.round(F.col("cand") - F.col("base"), 6)
    return j.select(
        *keys, F.round("base", 6).alias("base"), F.round("cand", 6).alias("cand"), delta.alias("delta"),
        F.coalesce(delta < 0, F.lit(True)).alias("regression"), F.coalesce(delta >= required_gain, F.lit(False)).alias("meets_gain"),
    )


# fixed values: cumulative Poisson(1) probabilities for 0..8 events
POISSON_ONE = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887)


def bootstrap_ci(df: DataFrame, key: str, num: Column, den: Column, b: int, seed: str, buckets: int = 1024, by: Sequence[str] = ()) -> DataFrame:
    """Percentile interval of sum(num)/sum(den) over Poisson replicates.

    Rows are first summed into hash buckets, so replicates multiply
    ``buckets`` rows instead of the data. Paired use: give num as a difference."""
    cells = df.groupBy(*by, F.pmod(h32(F.lit(f"{seed}|b|"), F.col(key)), F.lit(buckets)).alias("_b")).agg(F.sum(num).alias("_x"), F.sum(den).alias("_y"))
    reps = cells.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(b))))
    u = uniform(F.lit(f"{seed}|"), F.col("_b"), F.lit("|"), F.col("_r"))
    weight = reduce(lambda acc, t: acc + (u >= F.lit(t)).cast("int"), POISSON_ONE, F.lit(0))
    stat = reps.withColumn("_w", weight).groupBy(*by, "_r").agg(ratio(F.sum(F.col("_w") * F.col("_x")), F.sum(F.col("_w") * F.col("_y"))).alias("_s"))
    ci = stat.groupBy(*by).agg(F.percentile("_s", F.lit(0.025)).alias("low"), F.percentile("_s", F.lit(0.975)).alias("high"))
    point = cells.groupBy(*by).agg(ratio(F.sum("_x"), F.sum("_y")).alias("estimate"))
    if by:
        ci = point.join(ci, list(by))
    else:
        ci = point.withColumns({"low": ci.select("low").scalar(), "high": ci.select("high").scalar()})
    return ci.select(*by, *[F.round(c, 6).alias(c) for c in ("estimate", "low", "high")])


# --- model jobs -------------------------------------------------------------


def feature_stages(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    idx = [f"_{c}_i" for c in categorical]
    hot = [f"_{c}_h" for c in categorical]
    stages = [VectorAssembler(inputCols=list(numeric), outputCol="_num"), StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True)]
    if categorical:
        stages += [StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep"), OneHotEncoder(inputCols=idx, outputCols=hot, dropLast=False, handleInvalid="keep")]
    return [*stages, VectorAssembler(inputCols=["_scaled", *hot], outputCol="features")]


def train_gbt(
    train: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], rounds: int = 80, depth: int = 1, rate: float = 0.08, seed: int = 20260808
) -> PipelineModel:
    """Boosted stumps after scaling and indicator encoding."""
    gbt = GBTClassifier(labelCol=target, featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, cacheNodeIds=True, checkpointInterval=10)
    return Pipeline(stages=[*feature_stages(numeric, categorical), gbt]).fit(train)


def batch_score(model: PipelineModel, df: DataFrame, key: str, run_key: str, version: str, done: DataFrame | None = None, labels: Sequence[str] = ("negative", "positive")) -> DataFrame:
    """Prediction rows for a run key; rows already done under it are left out."""
    todo = df if done is None else df.join(done.where(F.col("run_key") == run_key).select(key), key, "left_anti")
    raw = [c for c in df.columns if c != key]
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in raw]))
    out = model.transform(todo.withColumn("_digest", digest))
    return out.select(
        key, F.lit(run_key).alias("run_key"), F.col("prediction").cast("int").alias("prediction"),
        F.when(F.col("prediction") == 1, labels[1]).otherwise(labels[0]).alias("label"),
        F.round(vector_to_array("probability")[1], 6).alias("probability"), F.lit(version).alias("model_version"), F.col("_digest").alias("input_digest"),
    )


def embed_clusters(df: DataFrame, key: str, vector: str, dims: int, k: int, seeds: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(assignments per seed, Rand index per pair of seeds) after PCA."""
    v = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    p = PCA(k=dims, inputCol="_v", outputCol="features").fit(v).transform(v).select(key, "features")
    parts = [KMeans(k=k, seed=s).fit(p).transform(p).select(key, F.lit(s).alias("seed"), F.col("prediction").alias("cluster")) for s in seeds]
    assigned = reduce(DataFrame.unionByName, parts)
    pairs = [(a, b) for i, a in enumerate(seeds) for b in list(seeds)[i + 1 :]]
    rand = [rand_index(assigned.where(F.col("seed") == a), assigned.where(F.col("seed") == b), key, "cluster").select(F.lit(a).alias("seed_a"), F.lit(b).alias("seed_b"), "rand_index") for a, b in pairs]
    return assigned, reduce(DataFrame.unionByName, rand)


def rand_index(a: DataFrame, b: DataFrame, key: str, cluster: str) -> DataFrame:
    """Pairwise agreement from the contingency table; no pair is built."""
    j = a.select(key, F.col(cluster).alias("_x")).join(b.select(key, F.col(cluster).alias("_y")), key)
    cells = j.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    two = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    both = cells.agg(F.sum(two("_n")).alias("s"), F.sum("_n").alias("n"))
    xs = cells.groupBy("_x").agg(F.sum("_n").alias("_n")).agg(F.sum(two("_n"))).scalar()
    ys = cells.groupBy("_y").agg(F.sum("_n").alias("_n")).agg(F.sum(two("_n"))).scalar()
    total = two("n")
    return both.withColumns({"_a": xs, "_b": ys}).select(F.round((total + 2 * F.col("s") - F.col("_a") - F.col("_b")) / total, 6).alias("rand_index"))


def budgeted_search(
    train: DataFrame, valid: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], grid: Sequence[dict], budget: int, fold_key: str, folds: int = 3
) -> DataFrame:
    """Logs every trial of the first ``budget`` settings: mean inner-fold score
    on train, outer score on valid, and which one the inner score picks."""
    prep = Pipeline(stages=feature_stages(numeric, categorical)).fit(train)
    tr, va = prep.transform(train), prep.transform(valid)
    tr = tr.withColumn("_fold", F.pmod(h32(F.col(fold_key), F.lit("fold")), F.lit(folds))).select("features", target, "_fold").cache()
    va = va.select("features", target).cache()
    acc = lambda m, d: m.transform(d).agg(F.avg((F.col("prediction") == F.col(target)).cast("double"))).first()[0]
    rows = []
    for i, params in enumerate(list(grid)[:budget]):
        lr = LogisticRegression(labelCol=target, **params)
        inner = [acc(lr.fit(tr.where(F.col("_fold") != f)), tr.where(F.col("_fold") == f)) for f in range(folds)]
        rows.append((i, str(sorted(params.items())), round(sum(inner) / folds, 6), round(acc(lr.fit(tr), va), 6)))
    best = max(rows, key=lambda r: (r[2], -r[0]))[0]
    tr.unpersist()
    va.unpersist()
    return train.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "trial int, params string, inner_score double, outer_score double, chosen boolean")
