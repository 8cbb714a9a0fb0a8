"""Splits, generated tables, scaling and encoding, as-of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sievework.functions.columns import clamp, logistic, normal, seconds, uniform
from sievework.functions.scan import last_known, number_rows


def hash_split(df: DataFrame, key: str, seed: str, n_train: int | None = None, fraction: float | None = None) -> DataFrame:
    """Adds ``split``. The fraction form is a row-local threshold. The exact
    form ranks by seeded hash; ranks are counted per hash prefix, so no task
    sorts more than one prefix."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    if n_train is None:
        return df.withColumn("split", F.when(uniform(F.lit(f"{seed}|"), F.col(key)) < F.lit(float(fraction)), "train").otherwise("test"))
    ranked = number_rows(df.withColumn("_h", h), ["_h", key], F.substring("_h", 1, 3), "_pos")
    return ranked.withColumn("split", F.when(F.col("_pos") <= n_train, "train").otherwise("test")).drop("_h", "_pos")


def group_time_split(df: DataFrame, group: str, ts: str, seed: str, test_groups: float, cut: Column, embargo_days: int) -> DataFrame:
    """No group on both sides; test rows start strictly after train rows end
    plus the embargo; rows that fit neither side are ``dropped``."""
    held = uniform(F.lit(f"{seed}|"), F.col(group)) < F.lit(float(test_groups))
    day = F.col(ts).cast("date")
    split = F.when(~held & (day < cut), "train").when(held & (day > F.date_add(cut, embargo_days)), "test").otherwise("dropped")
    return df.withColumn("split", split)


# fixed values: the generator's categories, weights, biases and bounds
PROPERTY_WEIGHTS = (("condo", 0.28), ("townhouse", 0.22), ("single-family", 0.50))
MARKET_WEIGHTS = (("cool", 0.28), ("balanced", 0.44), ("hot", 0.28))
BEDROOM_WEIGHTS = ((1, 0.08), (2, 0.24), (3, 0.38), (4, 0.22), (5, 0.08))
BATHROOM_WEIGHTS = ((1.0, 0.10), (1.5, 0.14), (2.0, 0.32), (2.5, 0.24), (3.0, 0.14), (3.5, 0.06))
PRICE_PER_FOOT = (("condo", 260.0), ("townhouse", 245.0), ("single-family", 235.0))
PROPERTY_BIAS = (("condo", 0.05), ("townhouse", 0.12), ("single-family", 0.0))
MARKET_BIAS = (("cool", -0.65), ("balanced", 0.0), ("hot", 0.65))


def _pick(u: Column, weights: Sequence[tuple[object, float]]) -> Column:
    total, out = 0.0, None
    for value, w in weights[:-1]:
        total += w
        cond = u < F.lit(round(total, 10))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(weights[-1][0])


def _lookup(c: str, pairs: Sequence[tuple[str, float]]) -> Column:
    out = None
    for k, v in pairs:
        out = F.when(F.col(c) == k, v) if out is None else out.when(F.col(c) == k, v)
    return out


def generate_listings(ids: DataFrame, key: str, seed: str) -> DataFrame:
    """Synthetic listings, one per given id. Every cell is a function of (seed,
    id, column), so partitioning never changes a value."""
    # fixed values: bounds, weights and coefficients of the listing law, down to the score
    u = lambda c: uniform(F.lit(f"{seed}|{c}|"), F.col(key))
    g = lambda c: normal(F.lit(f"{seed}|{c}|"), F.col(key))
    d = ids.select(key)
    d = d.withColumns(
        {
            "property_type": _pick(u("property"), PROPERTY_WEIGHTS), "market_temperature": _pick(u("market"), MARKET_WEIGHTS),
            "bedrooms": _pick(u("bedrooms"), BEDROOM_WEIGHTS), "bathrooms": _pick(u("bathrooms"), BATHROOM_WEIGHTS),
            "home_age_years": F.floor(u("age") * 96).cast("int"),
            "school_rating": clamp(F.bround(6.2 + g("school") * 1.8).cast("int"), 1, 10),
            "walk_score": clamp(F.bround(56 + g("walk") * 22).cast("int"), 5, 98),
            "mortgage_rate_percent": F.bround(5.2 + u("rate") * 3.2, 2),
        }
    )
    d = d.withColumn("square_feet", clamp((F.bround((780 + F.col("bedrooms") * 430 + F.col("bathrooms") * 115 + g("feet") * 190) / 10) * 10).cast("int"), 650, 3600))
    per_foot = (
        _lookup("property_type", PRICE_PER_FOOT) + F.col("school_rating") * 11 + F.col("walk_score") * 0.9 - F.col("home_age_years") * 0.55 + g("price") * 28
    )
    d = d.withColumn("listing_price_usd", clamp((F.bround(F.col("square_feet") * per_foot / 1000) * 1000).cast("int"), 160000, 1250000))
    score = (
        0.95 * ((F.col("school_rating") - 6) / 2.2 + (F.col("walk_score") - 55) / 35.0)
        - 1.05 * ((F.col("listing_price_usd") / F.col("square_feet") - 305) / 85)
        - 0.55 * ((F.col("mortgage_rate_percent") - 6.5) / 1.25)
        - 0.35 * ((F.col("home_age_years") - 35) / 35.0)
        + _lookup("property_type", PROPERTY_BIAS) + _lookup("market_temperature", MARKET_BIAS) + g("noise") * 0.55
    )
    return d.withColumn("sold_within_30_days", (u("sold") < logistic(score)).cast("int")).select(
        key, "listing_price_usd", "square_feet", "bedrooms", "bathrooms", "home_age_years", "school_rating", "walk_score",
        "mortgage_rate_percent", "property_type", "market_temperature", "sold_within_30_days",
    )


def standard_scale(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation, fitted on train; deviation 0 divides by 1.

    The fitted values are one row, read as a scalar subquery."""
    fit = train.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).alias("f"))
    out = df.withColumn("_fit", fit.scalar())
    for c in cols:
        sd = F.when(F.col(f"_fit.s_{c}") == 0, 1.0).otherwise(F.col(f"_fit.s_{c}"))
        out = out.withColumn(f"{c}_scaled", (F.col(c) - F.col(f"_fit.m_{c}")) / sd)
    return out.drop("_fit")


def one_hot(train: DataFrame, df: DataFrame, cols: Sequence[str], max_categories: int = 1000) -> DataFrame:
    """One indicator per train category; an unseen category gives zeros.

    More than ``max_categories`` values of a column is an error, since the
    categories become columns."""
    out = df
    for c in cols:
        seen = train.select(c).where(F.col(c).isNotNull()).distinct().limit(max_categories + 1).collect()
        if len(seen) > max_categories:
            raise ValueError(f"{c} has more than {max_categories} categories")
        for (v,) in sorted(seen):
            out = out.withColumn(f"{c}={v}", F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("int"))
    return out


def point_in_time_join(
    entities: DataFrame, features: DataFrame, key: str, ts: str, entity_id: str, feature_id: str, values: Sequence[str],
    ttl_seconds: int, block_seconds: int = 86400,
) -> DataFrame:
    """Newest feature at or before each entity time and within the ttl.

    Both sides are stacked and scanned in time order; nothing is range-joined,
    and a key with very many rows is scanned block by block."""
    vals = F.struct(F.col(ts).alias("at"), *values)
    blank = F.lit(None).cast(features.select(vals.alias("v")).schema["v"].dataType)
    right = features.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(0).alias("_side"), F.col(feature_id).cast("bigint").alias("_tie"), vals.alias("_val"))
    left = entities.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.col(entity_id).cast("bigint").alias("_tie"), blank.alias("_val"))
    block = F.floor(F.unix_micros(F.col("_ts").cast("timestamp")) / (1000000 * block_seconds))
    got = last_known(right.unionByName(left), ["_key"], ["_ts", "_side", "_tie"], block, hit=F.col("_val")).where("_side = 1")
    fresh = seconds(F.col("_ts")) - seconds(F.col("hit.at")) <= ttl_seconds
    return got.select(
        F.col("_tie").alias(entity_id), F.col("_key").alias(key), F.col("_ts").alias(ts),
        F.when(fresh, F.col("hit.at")).alias("feature_ts"), *[F.when(fresh, F.col(f"hit.{v}")).alias(v) for v in values],
    )


def latest_features(features: DataFrame, key: str, ts: str, tie: str, values: Sequence[str], now: Column, stale_seconds: int) -> DataFrame:
    """Newest value per entity, its age and a stale flag."""
    new = features.groupBy(key).agg(F.max_by(F.struct(ts, *values), F.struct(ts, tie)).alias("_f"))
    age = seconds(now) - seconds(F.col(f"_f.{ts}"))
    return new.select(key, F.col(f"_f.{ts}").alias(ts), *[F.col(f"_f.{v}").alias(v) for v in values], age.alias("age_s"), (age > stale_seconds).alias("stale"))
