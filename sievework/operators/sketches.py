"""Sketches as stored columns: figures of windows that merge without the rows.

A stored row holds, for one key and window, counts, a KLL sketch of every numeric
column (quantiles), a Theta sketch of an id column (distinct values, also their
overlap between periods) and an exact table of a category column's commonest
values with a bound for the others. Any rows of the store, of any windows and
versions, merge into figures of their union.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

KLL_K = 400
# Rank error of one KLL quantile at this size, with 99 percent confidence.
RANK_ERROR = 0.009
THETA_LG = 14
LISTED = 32


def sketch_windows(df: DataFrame, keys: Sequence[str], ts: str, window_seconds: int, numeric: Sequence[str], distinct: str, category: str, version: str, listed: int = LISTED) -> DataFrame:
    """Stored sketches by (keys, window_start): n, ``q_<column>`` (KLL), ``d``
    (Theta), ``common`` (the ``listed`` commonest categories with exact counts) and
    ``rest`` (the greatest count that a category outside of them can have).

    Everything is a partial aggregate, so a hot key is combined before it travels."""
    start = F.timestamp_seconds(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (1_000_000 * window_seconds)) * window_seconds)
    src = df.withColumn("window_start", start)
    part = [*keys, "window_start"]
    quantiles = [F.kll_sketch_agg_double(F.col(c).cast("double"), KLL_K).alias(f"q_{c}") for c in numeric]
    main = src.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), *quantiles, F.theta_sketch_agg(F.col(distinct), THETA_LG).alias("d"))
    counts = src.groupBy(*part, F.col(category).cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    top = _listed(counts.withColumnRenamed("_v", "value"), part, "_n", listed + 1).groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("place", F.col("value").alias("v"), F.col("_n").alias("n")))).alias("_top"))
    common = F.transform(F.slice("_top", 1, listed), lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n")))
    top = top.select(*part, common.alias("common"), F.when(F.size("_top") > listed, F.get("_top", F.lit(listed))["n"]).otherwise(0).alias("rest"))
    return main.join(top, part).withColumn("version", F.lit(version))


def _listed(counts: DataFrame, by: Sequence[str], count: str, k: int) -> DataFrame:
    """The k rows of the greatest counts by group, ties to the smaller value; each
    task keeps k rows a group before they travel."""
    w = Window.partitionBy(*by).orderBy(F.desc(count), "value")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def merge_quantiles(stored: DataFrame, by: Sequence[str], column: str, probs: dict[str, float]) -> DataFrame:
    """(by, n, one column for each probability): quantiles of the union of stored
    rows, off by at most about ``RANK_ERROR`` of the rank."""
    m = stored.groupBy(*by).agg(F.kll_merge_agg_double(f"q_{column}").alias("_q"))
    return m.select(*by, F.kll_sketch_get_n_double("_q").alias("n"), *[F.kll_sketch_get_quantile_double("_q", F.lit(p)).alias(name) for name, p in probs.items()])


def merge_distinct(stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, distinct): estimated distinct ids of the union of stored rows; exact
    below 2^``THETA_LG`` of them."""
    return stored.groupBy(*by).agg(F.theta_sketch_estimate(F.theta_union_agg("d", THETA_LG)).alias("distinct"))


def overlap(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, both, only_a, only_b): estimated ids that two sets of stored rows share."""
    one = lambda d, name: d.groupBy(*by).agg(F.theta_union_agg("d", THETA_LG).alias(name))
    j = one(a, "_a").join(one(b, "_b"), list(by))
    size = F.theta_sketch_estimate
    return j.select(*by, size(F.theta_intersection("_a", "_b")).alias("both"), size(F.theta_difference("_a", "_b")).alias("only_a"), size(F.theta_difference("_b", "_a")).alias("only_b"))


def merge_common(stored: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """(by, value, least, most): the k values of the greatest known counts in the
    union, with bounds of their true counts: what is listed, and that plus the
    greatest unlisted count of every row that does not list them."""
    rests = stored.groupBy(*by).agg(F.sum("rest").alias("_r"))
    each = stored.select(*by, "rest", F.explode("common").alias("x"))
    sums = each.groupBy(*by, F.col("x.v").alias("value")).agg(F.sum("x.n").alias("least"), F.sum("rest").alias("_own"))
    j = sums.join(rests, list(by)).withColumn("most", F.col("least") + F.col("_r") - F.col("_own"))
    return _listed(j, by, "least", k).select(*by, "value", "least", "most")
