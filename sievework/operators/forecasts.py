"""Rolling-origin folds, seasonal and regression forecasts, horizon metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievework.functions.linear import least_squares, predicted
from sievework.functions.scan import exact_quantiles


def backtest_folds(df: DataFrame, day: str, last: Column, k: int, horizon: int) -> DataFrame:
    """Rows with (fold, role): fold f trains before its origin and tests on the
    next ``horizon`` days; origins step back from ``last`` by one horizon."""
    f = F.explode(F.sequence(F.lit(1), F.lit(k)))
    out = df.withColumn("fold", f).withColumn("origin", F.date_add(F.date_sub(last, (F.lit(k + 1) - F.col("fold")) * horizon), 1))
    role = F.when(F.col(day) < F.col("origin"), "train").when(F.col(day) < F.date_add("origin", horizon), "test")
    return out.withColumn("role", role).where("role is not null")


def seasonal_naive(series: DataFrame, day: str, y: str, season: int, horizon: int) -> DataFrame:
    """Forecast rows (day, horizon, forecast, low, high, actual): the value a
    whole number of seasons back that was known at the origin; the interval
    adds the 10% and 90% residual quantiles of the same horizon."""
    target = series.select(F.col(day).alias("_t"), F.col(y).alias("actual")).withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    back = F.ceil(F.col("horizon") / F.lit(float(season))) * season
    target = target.withColumn("_d", F.date_sub("_t", back.cast("int")))
    j = target.join(series.select(F.col(day).alias("_d"), F.col(y).alias("forecast")), "_d").withColumn("_res", F.col("actual") - F.col("forecast"))
    q = exact_quantiles(j, ["horizon"], "_res", {"_q10": 0.1, "_q90": 0.9})
    return j.join(q, "horizon").select(
        F.col("_t").alias(day), "horizon", "forecast", (F.col("forecast") + F.col("_q10")).alias("low"), (F.col("forecast") + F.col("_q90")).alias("high"), "actual"
    )


def lag_regression_forecast(series: DataFrame, day: str, y: str, last: Column, k: int, horizon: int, lags: tuple[int, ...] = (7, 14, 28), ridge: float = 0.01) -> DataFrame:
    """Linear model on lag and calendar features, fitted per fold: least squares
    plus ``ridge`` times the squared slopes. Every lag is at least the horizon, so
    no test feature looks past the origin.

    All folds are fitted by one aggregation of the products of their features (the
    normal equations); only those sums, one small row a fold, meet the solver."""
    if min(lags) < horizon:
        raise ValueError("a lag shorter than the horizon would look ahead")
    feats = series
    for n in lags:
        past = series.select(F.date_add(day, n).alias(day), F.col(y).alias(f"lag_{n}"))
        feats = feats.join(past, day)
    x = [F.lit(1.0), *[F.col(f"lag_{n}").cast("double") for n in lags], F.dayofweek(day).cast("double"), F.month(day).cast("double")]
    size = len(x)
    folds = backtest_folds(feats.select(day, F.col(y).cast("double").alias(y), F.array(*x).alias("x")), day, last, k, horizon)
    weights = least_squares(folds.where("role = 'train'"), ["fold"], "x", y, size, ridge)
    dot = predicted("x", "w")
    test = folds.where("role = 'test'").join(weights, "fold")
    return test.select("fold", day, (F.datediff(day, "origin") + 1).alias("horizon"), dot.alias("forecast"), F.col(y).alias("actual"))


def horizon_metrics(forecasts: DataFrame) -> DataFrame:
    """MAE, RMSE, MAPE (zero actuals left out), interval coverage and width."""
    e = F.col("actual") - F.col("forecast")
    inside = (F.col("actual") >= F.col("low")) & (F.col("actual") <= F.col("high"))
    return forecasts.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
        F.round(F.avg(F.when(F.col("actual") != 0, F.abs(e / F.nullif(F.col("actual"), F.lit(0.0))))), 6).alias("mape"),
        F.round(F.avg(inside.cast("double")), 6).alias("coverage"), F.round(F.avg(F.col("high") - F.col("low")), 6).alias("width"),
    )
