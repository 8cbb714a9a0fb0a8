"""Copies of real rows in generated data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievework.functions.columns import ratio
from sievework.functions.ivf import build_ivf, ivf_topk
from sievework.session import scratch_path


def nearest_copies(syn: DataFrame, train: DataFrame, held: DataFrame, key: str, vector: str, exact: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(per generated row: nearest distance to train and held-out, exact copy;
    one summary row). A share nearer to train well over one half, or any exact
    copy, points to memorized rows.

    Exact nearest rows from an inverted file: the angle between a row and a list's
    centroid bounds all of the list, so lists too far away are never read."""

    def near(real: DataFrame, name: str) -> DataFrame:
        q = syn.select(F.col(key).alias("query_id"), F.col(vector).alias("vector"))
        i = real.select(F.col(key).alias("item_id"), F.col(vector).alias("vector"))
        return ivf_topk(q, build_ivf(i, scratch_path(syn.sparkSession, "nearest")), 1).select(F.col("query_id").alias(key), F.round(1 - F.col("score"), 6).alias(name))

    rows = near(train, "train_distance").join(near(held, "held_distance"), key)
    rows = rows.withColumn("exact_copy", F.col("train_distance") <= exact).withColumn("nearer_train", F.col("train_distance") < F.col("held_distance"))
    n = F.count(F.lit(1))
    return rows, rows.agg(
        n.alias("n"), F.count_if("exact_copy").alias("exact_copies"), F.round(ratio(F.count_if("nearer_train"), n), 6).alias("memorization_ratio")
    )
