"""Forecasts of weekly indices: features, estimators, rolling-origin backtest, scores and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import kernels as K


def lags(df: DataFrame, by: Sequence[str], week: str, value: str, offsets: Sequence[int]) -> DataFrame:
    """Adds value of `offset` calendar weeks before, NULL where that week is absent (no row counting)."""
    w = Window.partitionBy(*by).orderBy(F.datediff(F.col(week), F.lit("1970-01-05").cast("date")))
    for k in offsets:
        df = df.withColumn(f"{value}_lag_{k}", F.first(value).over(w.rangeBetween(-7 * k, -7 * k)))
    return df


def naive(df: DataFrame, by: Sequence[str], week: str, value: str, horizon: int) -> DataFrame:
    """(by, origin, target, predicted, actual): persistence from every origin whose target week is there."""
    actual = df.select(*by, F.col(week).alias("target"), F.col(value).alias("actual"))
    return df.select(*by, F.col(week).alias("origin"), F.date_add(week, 7 * horizon).alias("target"), F.col(value).alias("predicted")).join(actual, [*by, "target"])


def seasonal(df: DataFrame, by: Sequence[str], week: str, value: str, horizon: int, season: int = 52) -> DataFrame:
    """Forecast by the value one season before the target, known at the origin."""
    back = 7 * (season - horizon)
    past = df.select(*by, F.date_add(week, back).alias("origin"), F.col(value).alias("predicted"))
    actual = df.select(*by, F.col(week).alias("target"), F.col(value).alias("actual"))
    origins = df.select(*by, F.col(week).alias("origin"))
    return origins.join(past, [*by, "origin"]).withColumn("target", F.date_add("origin", 7 * horizon)).join(actual, [*by, "target"])


def residual_interval(df: DataFrame, by: Sequence[str], confidence: float = 0.8) -> DataFrame:
    """(by, low, high): quantiles of actual - predicted; both 0 where nothing was observed."""
    lo, hi = (1 - confidence) / 2, (1 + confidence) / 2
    r = F.col("actual") - F.col("predicted")
    return df.groupBy(*by).agg(F.coalesce(F.percentile(r, F.lit(lo)), F.lit(0.0)).alias("low"), F.coalesce(F.percentile(r, F.lit(hi)), F.lit(0.0)).alias("high"))


def holt(series: DataFrame, by: Sequence[str], week: str, value: str, horizon: int, *, season: int = 52) -> DataFrame:
    """(by, origin, target, predicted, low, high): additive damped trend from each series' end, with an additive season
    from two whole seasons of values on; parameters of least squared one-step error. A series is one key's weeks, 8 with a
    value at least; keys are spread over tasks."""
    import numpy as np
    import pandas as pd

    from tidemark.functions import smoothing as E

    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in by)

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(week)
        y = part[value].to_numpy(float)
        y = y[np.isfinite(y)]
        names = [*by, "origin", "target", "predicted", "low", "high"]
        if len(y) < 8:
            return pd.DataFrame(columns=names)
        cycle = season if len(y) >= 2 * season else 0
        best = E.parameters(E.fitted(y.tolist(), cycle))
        path = E.path(y.tolist(), best, cycle)
        origin = part[week].iloc[-1]
        row = [*key, origin, origin + pd.Timedelta(days=7 * horizon), *E.interval(path.point(len(y) - 1, horizon, best.damping), y - np.array(path.ahead), horizon)]
        return pd.DataFrame([row], columns=names)

    return series.select(*by, week, value).groupBy(*by).applyInPandas(fit, f"{kinds}, origin date, target date, predicted double, low double, high double")


def scores(backtest: DataFrame, reference: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(by, n, mae, mase): errors of a model beside those of the reference on the same origins; MASE is NULL where the
    reference makes no error."""
    base = reference.select(*keys, F.abs(F.col("actual") - F.col("predicted")).alias("_e0"))
    own = backtest.select(*keys, F.abs(F.col("actual") - F.col("predicted")).alias("_e")).join(base, list(keys))
    out = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_e").alias("mae"), F.avg("_e0").alias("_m"))
    return out.select(*by, "n", "mae", F.when(F.col("_m") > K.EPSILON, F.col("mae") / F.nullif(F.col("_m"), F.lit(0.0))).alias("mase"))


def selected(scored: DataFrame, by: Sequence[str], model: str = "model") -> DataFrame:
    """The model of lowest MASE below 1, else naive without skill."""
    good = scored.where("mase < 1")
    best = good.groupBy(*by).agg(F.min_by(model, F.struct("mase", model)).alias("_b"))
    return scored.select(*by).distinct().join(best, list(by), "left").select(*by, F.coalesce("_b", F.lit("naive")).alias("model"), F.when(F.col("_b").isNull(), "no_skill").otherwise("skill").alias("status"))


def tier(position: Column, n: Column) -> Column:
    """Popularity tier from a 0-based position among n: lowest third, highest third, or middle; alone: middle."""
    share = position / F.nullif(n - 1, F.lit(0))
    return F.when(n <= 1, "middle").when(share <= 1 / 3, "low").when(share >= 2 / 3, "high").otherwise("middle")
