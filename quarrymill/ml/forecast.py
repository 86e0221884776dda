"""Forecasts of regular series by a linear trend with a band, behind a gate, with a backtest. All in built-in aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GATE, BACKTEST_FROM, BACKTEST_STEPS, AHEAD, Z = 12, 16, 4, 13, 1.959963984540054


def clipped(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def numbered(series: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """x: days since the series' first point; i and n: place and number of points."""
    w = Window.partitionBy(*keys)
    return series.withColumn("__x", F.datediff(F.col(at), F.min(at).over(w)).cast("double")).withColumn("__i", F.row_number().over(w.orderBy(at))).withColumn("__n", F.count("*").over(w))


def trend(points: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    y, x = F.col(value), F.col("__x")
    return points.groupBy(*keys).agg(
        F.count(value).alias("__n"), F.max("__x").alias("__last_x"), F.max_by(value, "__x").alias("__last_value"), F.avg(x).alias("__mx"),
        F.regr_slope(y, x).alias("__slope"), F.regr_intercept(y, x).alias("__intercept"), F.regr_sxx(y, x).alias("__sxx"), F.regr_syy(y, x).alias("__syy"), F.regr_sxy(y, x).alias("__sxy"))


def forecast(series: DataFrame, keys: Sequence[str], at: str, value: str, step: int = 7, ahead: int = AHEAD, gate: int = GATE) -> DataFrame:
    """(keys..., status, n_points, last_at, last_value, forecast_at, forecast, lower, upper).

    A series of fewer than `gate` points has one row with status insufficient_history and no forecast; others have `ahead` rows.
    """
    p = numbered(series.where(F.col(value).isNotNull()), keys, at)
    t = trend(p, keys, value).join(p.groupBy(*keys).agg(F.max(at).alias("last_at")), list(keys))
    sd = F.sqrt(F.greatest(F.col("__syy") - F.col("__sxy") * F.col("__sxy") / F.col("__sxx"), F.lit(0.0)) / (F.col("__n") - 2))
    enough = F.col("__n") >= gate
    k = F.explode(F.when(enough, F.sequence(F.lit(1), F.lit(ahead))).otherwise(F.array(F.lit(0)))).alias("__k")
    e = t.withColumn("__sd", F.when(F.col("__n") > 2, sd)).select("*", k)
    x = F.col("__last_x") + F.col("__k") * step
    yhat = F.col("__intercept") + F.col("__slope") * x
    half = Z * F.col("__sd") * F.sqrt(1 + 1 / F.col("__n") + F.pow(x - F.col("__mx"), 2) / F.col("__sxx"))
    ok = F.col("__k") > 0
    return e.select(*keys, F.when(ok, "forecast").otherwise("insufficient_history").alias("status"), F.col("__n").alias("n_points"), "last_at", F.col("__last_value").alias("last_value"),
                    F.when(ok, F.date_add("last_at", (F.col("__k") * step).cast("int"))).alias("forecast_at"), *[F.when(ok, clipped(c)).alias(a) for c, a in ((yhat, "forecast"), (yhat - half, "lower"), (yhat + half, "upper"))])


def backtest(series: DataFrame, keys: Sequence[str], at: str, value: str, least: int = BACKTEST_FROM, steps: int = BACKTEST_STEPS) -> DataFrame:
    """(keys..., mae_trend, mae_naive): each of the last `steps` points predicted from the points before it, and by the one before it."""
    p = numbered(series.where(F.col(value).isNotNull()), keys, at).where(F.col("__n") >= least)
    t = p.where(F.col("__i") > F.col("__n") - steps).select(*keys, F.col("__x").alias("__tx"), F.col("__i").alias("__ti"), F.col(value).alias("__ty"))
    h = t.join(p.select(*keys, "__x", "__i", value), list(keys)).where(F.col("__i") < F.col("__ti"))  # a series has few points
    fit = h.groupBy(*keys, "__tx", "__ty").agg(F.regr_slope(F.col(value), F.col("__x")).alias("__b"), F.regr_intercept(F.col(value), F.col("__x")).alias("__a"), F.max_by(value, "__i").alias("__before"))
    return fit.groupBy(*keys).agg(F.avg(F.abs(clipped(F.col("__a") + F.col("__b") * F.col("__tx")) - F.col("__ty"))).alias("mae_trend"), F.avg(F.abs(F.col("__before") - F.col("__ty"))).alias("mae_naive"))
