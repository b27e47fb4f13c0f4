"""Rolling-origin backtests: every estimator from every origin, scored at two grains, and what follows from the scores.

Only what was known at an origin enters a forecast from it: windows end at the origin, targets lie after it. A series is
one key's weeks; keys are spread over tasks and each stays within one window or group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions import smoothing as E
from tidemark.operators import boosting
from tidemark.operators.forecast import lags

RECORD = ["horizon", "model", "origin", "target", "training_weeks", "predicted", "low", "high", "actual"]


def _day(week: str | Column) -> Column:
    return F.datediff(F.col(week) if isinstance(week, str) else week, F.lit("1970-01-05").cast("date"))


def features(df: DataFrame, by: str, week: str, target: str, carried: Sequence[str], horizon: int, *, opportunity: str, fallback: str, embedding: str, best: int = 10) -> DataFrame:
    """(by, origin, target_week, features of the origin): the target's four last calendar weeks, carried columns, the cosine
    to the mean embedding of the week's `best` categories by opportunity (or its fallback), the target's week of the
    year, and the category's number in order. NULL where nothing is known; similarity is 0 without an embedding.
    """
    out = lags(df, [by], week, target, range(4))
    score = F.coalesce(F.col(opportunity), F.col(fallback))
    place = F.row_number().over(Window.partitionBy(week).orderBy(F.col(embedding).isNull(), score.desc_nulls_last(), F.col(by)))
    top = df.where(F.col(embedding).isNotNull()).withColumn("_p", place).where(F.col("_p") <= best)
    mean = top.select(week, F.posexplode(embedding).alias("_i", "_x")).groupBy(week, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    mean = mean.groupBy(week).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_c"))
    # categories are a dimension: one short window numbers them
    ids = df.select(by).distinct().withColumn("category_code", (F.row_number().over(Window.orderBy(by)) - 1).cast("double"))
    out = out.join(mean, week, "left").join(ids, by)
    goal = F.date_add(week, 7 * horizon)
    return out.select(by, F.col(week).alias("origin"), goal.alias("target_week"), *(F.col(f"{target}_lag_{k}").alias(f"target_lag_{k + 1}") for k in range(4)), *carried, F.coalesce(K.cosine(F.col(embedding), F.col("_c")), F.lit(0.0)).alias("trend_similarity"), F.weekofyear(goal).cast("double").alias("week_of_year"), "category_code")


def trained_weeks(df: DataFrame, by: Sequence[str], week: str, value: str) -> DataFrame:
    """(by, week, value, training_weeks): of the rows with a value, how long their unbroken run is up to them."""
    own = K.islands(df.where(F.col(value).isNotNull()).select(*by, week, value), by, week)
    return own.withColumn("training_weeks", (F.datediff(week, "run") / 7 + 1).cast("int")).drop("run")


def _known_errors(df: DataFrame, by: Sequence[str], error: str, back: int) -> Column:
    """Quantiles 0.1 and 0.9 of the errors whose targets lie `back` days or more before a row's day."""
    w = Window.partitionBy(*by).orderBy("_day").rangeBetween(Window.unboundedPreceding, -back)
    return F.percentile(F.col(error), F.array(F.lit(0.1), F.lit(0.9))).over(w)


def persistent(df: DataFrame, by: Sequence[str], week: str, value: str, horizons: Sequence[int], *, season: int = 52, minimum: int = 8) -> DataFrame:
    """Backtest records of naive and seasonal: from every origin with `minimum` unbroken weeks whose target has a value.

    Intervals add the quantiles of the errors known at the origin to the point, and hold it.
    """
    runs = trained_weeks(df, by, week, value).withColumn("_day", _day(week))
    known = Window.partitionBy(*by).orderBy("_day")
    at = lambda d: F.first(value).over(known.rangeBetween(d, d))
    out = None
    for h in horizons:
        # each row is a target; its origin lies h weeks before
        own = runs.withColumn("_origin", at(-7 * h)).withColumn("_cycle", at(-7 * season)).withColumn("_training", F.first("training_weeks").over(known.rangeBetween(-7 * h, -7 * h)))
        own = own.withColumn("_e_naive", F.col(value) - F.col("_origin")).withColumn("_e_seasonal", F.col(value) - F.col("_cycle"))
        own = own.withColumn("_q_naive", _known_errors(own, by, "_e_naive", 7 * h)).withColumn("_q_seasonal", _known_errors(own, by, "_e_seasonal", 7 * h))
        own = own.where(F.col("_training") >= minimum)
        # both models from one row: windows are worked out once
        both = []
        for model, point in (("naive", "_origin"), ("seasonal", "_cycle")):
            low, high = (F.col(point) + F.coalesce(F.col(f"_q_{model}")[i], F.lit(0.0)) for i in (0, 1))
            both.append(F.struct(F.lit(model).alias("model"), F.col(point).alias("predicted"), F.least(point, low).alias("low"), F.greatest(point, high).alias("high")))
        rows = own.select(*by, F.lit(h).alias("horizon"), F.date_sub(week, 7 * h).alias("origin"), F.col(week).alias("target"), F.col("_training").alias("training_weeks"), F.col(value).alias("actual"), F.explode(F.array(*both)).alias("_m"))
        rows = rows.where("_m.predicted is not null").select(*by, "horizon", "_m.model", "origin", "target", "training_weeks", "_m.predicted", "_m.low", "_m.high", "actual")
        out = rows if out is None else out.unionByName(rows)
    return out


GRID = [(a, b, p) for a in (0.1, 0.3, 0.5, 0.8) for b in (0.05, 0.2) for p in (0.8, 0.95)]


def damped_paths(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-step forecasts, levels and trends (one row a step, one column a member of GRID) of an additive damped trend."""
    a, b, phi = (np.array([g[i] for g in GRID]) for i in range(3))
    level, trend = np.full(len(GRID), y[0]), np.full(len(GRID), y[1] - y[0])
    out = np.empty((3, len(y), len(GRID)))
    for i, v in enumerate(y):
        ahead = level + phi * trend
        new = a * v + (1 - a) * ahead
        trend = b * (new - level) + (1 - b) * phi * trend
        level = new
        out[:, i] = ahead, level, trend
    return out[0], out[1], out[2]


def damped(df: DataFrame, by: Sequence[str], week: str, value: str, horizons: Sequence[int], *, minimum: int = 8) -> DataFrame:
    """Backtest records of the damped trend, model ets. A run's states do not depend on where it is cut, so that one pass
    gives every origin's: parameters are those of the least squared one-step error up to it."""
    runs = K.islands(df.where(F.col(value).isNotNull()).select(*by, week, value), by, week)
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)
    names = [*by, *RECORD]

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        part = part.sort_values(week)
        known = dict(zip(part[week], part[value], strict=True))
        for _, run in part.groupby("run"):
            y, weeks = run[value].to_numpy(float), list(run[week])
            if len(y) < minimum:
                continue
            ahead, level, trend = damped_paths(y)
            error = y[:, None] - ahead
            loss = np.cumsum(np.vstack([np.zeros(len(GRID)), error[1:] ** 2]), axis=0)
            for i in range(minimum - 1, len(y)):
                g = int(np.argmin(loss[i]))
                q = np.quantile(error[: i + 1, g], [0.1, 0.9])
                for h in horizons:
                    target = weeks[i] + pd.Timedelta(days=7 * h)
                    if target in known:
                        x = level[i, g] + trend[i, g] * sum(GRID[g][2] ** k for k in range(1, h + 1))
                        low, high = x + q * np.sqrt(h)
                        rows.append([*key, h, "ets", weeks[i], target, i + 1, x, min(x, low), max(x, high), known[target]])
        return pd.DataFrame(rows, columns=names)

    schema = f"{kinds}, horizon int, model string, origin date, target date, training_weeks int, predicted double, low double, high double, actual double"
    return runs.groupBy(*by).applyInPandas(one, schema)


def smoothed(df: DataFrame, by: Sequence[str], week: str, value: str, horizons: Sequence[int], *, minimum: int = 8, season: int = 52, refit: int = 13) -> DataFrame:
    """Backtest records of exponential smoothing with a damped trend and, from two whole seasons on, a season: model ets.

    Parameters are fitted anew every `refit` origins of a run (and when the season comes in), from what was known then,
    and hold until the next fit; states run on. Errors that make the interval are those up to the origin.
    """
    runs = K.islands(df.where(F.col(value).isNotNull()).select(*by, week, value), by, week)
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)
    names = [*by, *RECORD]

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        part = part.sort_values(week)
        known = dict(zip(part[week], part[value], strict=True))
        for _, run in part.groupby("run"):
            y, weeks = run[value].tolist(), list(run[week])
            found, path, since = None, None, 0
            for i in range(minimum - 1, len(y)):
                cycle = season if i + 1 >= 2 * season else 0
                if path is None or i - since >= refit or cycle != path.cycle:
                    found, since = E.fitted(y[: i + 1], cycle, found), i
                    # states do not depend on where a run is cut
                    best, path = E.parameters(found), E.path(y, E.parameters(found), cycle)
                    errors = np.array(y) - np.array(path.ahead)
                for h in horizons:
                    target = weeks[i] + pd.Timedelta(days=7 * h)
                    if target in known:
                        rows.append([*key, h, "ets", weeks[i], target, i + 1, *E.interval(path.point(i, h, best.damping), errors[: i + 1], h), known[target]])
        return pd.DataFrame(rows, columns=names)

    schema = f"{kinds}, horizon int, model string, origin date, target date, training_weeks int, predicted double, low double, high double, actual double"
    return runs.groupBy(*by).applyInPandas(one, schema)


POOLED = ["lag_1", "lag_2", "lag_3", "lag_4", "cycle", "mean_4", "family_mean", "family_size", "week_of_year", "category_code", "family_code"]


def pooled_examples(df: DataFrame, category: str, family: str, axis: str, week: str, value: str, horizons: Sequence[int], *, season: int = 52) -> DataFrame:
    """(category, family, axis, horizon, origin, target, training_weeks, POOLED, actual): what is known at every origin with a
    value, and the target's value (NULL if it has none). Lags are calendar weeks; family_mean and family_size are those of
    the origin's week; codes are numbers of the names in order."""
    known = [category, family, axis]
    own = trained_weeks(df, known, week, value)
    wide = lags(own, known, week, value, [*range(4), *(season - h for h in horizons)])
    peers = Window.partitionBy(family, axis, week)
    wide = wide.withColumn("family_mean", F.avg(value).over(peers)).withColumn("family_size", F.count(value).over(peers).cast("double"))
    # names are dimensions: one short window numbers each
    code = lambda c, name: df.select(c).distinct().withColumn(name, (F.row_number().over(Window.orderBy(c)) - 1).cast("double"))
    wide = wide.join(code(category, "category_code"), category).join(code(family, "family_code"), family)
    four = [F.col(f"{value}_lag_{k}") for k in range(4)]
    held = sum((F.coalesce(x, F.lit(0.0)) for x in four[1:]), F.coalesce(four[0], F.lit(0.0)))
    count = sum((x.isNotNull().cast("int") for x in four[1:]), four[0].isNotNull().cast("int"))
    out = None
    for h in horizons:
        goal = F.date_add(week, 7 * h)
        rows = wide.select(*known, F.lit(h).alias("horizon"), F.col(week).alias("origin"), goal.alias("target"), "training_weeks", *(x.alias(f"lag_{k + 1}") for k, x in enumerate(four)), F.col(f"{value}_lag_{season - h}").alias("cycle"), (held / F.nullif(count, F.lit(0))).alias("mean_4"), "family_mean", "family_size", F.weekofyear(goal).cast("double").alias("week_of_year"), "category_code", "family_code")
        out = rows if out is None else out.unionByName(rows)
    actual = own.select(*known, F.col(week).alias("target"), F.col(value).alias("actual"))
    return out.join(actual, [*known, "target"], "left")


def boosted(examples: DataFrame, cuts: Sequence, by: Sequence[str], axis: str, *, minimum: int = 8, **parameters) -> DataFrame:
    """Backtest records of pooled quantile boosting, model gbm: each origin is forecast by the models fitted at the last
    cut that is not after it, from examples whose targets were known by then. One model for each axis, horizon and cut;
    categories are pooled. An example is copied for every cut from its target on."""
    own = examples.withColumn("_cut", F.explode(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: F.col("target") <= c)))
    keys = [axis, "horizon", "_cut"]
    fitted = boosting.fit(own.where(F.col("training_weeks") >= minimum), keys, POOLED, "actual", **parameters)
    asked = examples.where((F.col("training_weeks") >= minimum) & F.col("actual").isNotNull()).withColumn("_cut", boosting.last_cut(cuts, F.col("origin"))).where(F.col("_cut").isNotNull())
    return boosting.forecast(asked, fitted).select(*by, *(F.lit("gbm").alias(c) if c == "model" else F.col(c) for c in RECORD))


def paired(records: DataFrame, pair: Sequence[str]) -> DataFrame:
    """Records that naive has too, by `pair`, with both errors."""
    error = F.abs(F.col("actual") - F.col("predicted"))
    naive = records.where("model = 'naive'").select(*pair, error.alias("_e0"))
    return records.withColumn("_e", error).join(naive, list(pair))


def scored(records: DataFrame, by: Sequence[str], pair: Sequence[str], expected: DataFrame | None = None) -> DataFrame:
    """(by, origins, mae, naive_mae, mase, coverage, width, status) of the records that naive has too, by `pair`.

    MASE is NULL where naive makes no error. Expected keys without a pair get a row of NULLs, status missing. Records may
    be paired already.
    """
    own = records if "_e0" in records.columns else paired(records, pair)
    inside = F.when((F.col("low") <= F.col("actual")) & (F.col("actual") <= F.col("high")), 1.0).otherwise(0.0)
    out = own.groupBy(*by).agg(F.count(F.lit(1)).alias("origins"), F.avg("_e").alias("mae"), F.avg("_e0").alias("naive_mae"), F.avg(inside).alias("coverage"), F.avg(F.col("high") - F.col("low")).alias("width"))
    if expected is not None:
        out = expected.join(out, list(by), "left")
    scale = F.col("naive_mae") > K.EPSILON
    status = F.when(F.col("naive_mae").isNull(), "missing").when(scale, "scored").otherwise("zero_naive_scale")
    return out.select(*by, F.coalesce("origins", F.lit(0)).alias("origins"), "mae", "naive_mae", F.when(scale, F.col("mae") / F.nullif("naive_mae", F.lit(0.0))).alias("mase"), "coverage", "width", status.alias("status"))


def chosen(fine: DataFrame, coarse: DataFrame, by: Sequence[str], group: Sequence[str]) -> DataFrame:
    """(by, model, mase, skill): the model of least MASE among those below 1 at both grains, else naive without skill."""
    both = coarse.where("status = 'scored' and mase < 1").select(*group, "model")
    good = fine.where("status = 'scored' and mase < 1 and model <> 'naive'").join(both, [*group, "model"], "left_semi")
    best = good.groupBy(*by).agg(F.min_by(F.struct("model", "mase"), F.struct("mase", "model")).alias("_b"))
    return fine.select(*by).distinct().join(best, list(by), "left").select(*by, F.coalesce("_b.model", F.lit("naive")).alias("model"), F.col("_b.mase").alias("mase"), F.when(F.col("_b").isNull(), "no_skill").otherwise("skill").alias("skill"))


def next_up(current: DataFrame, axes: Sequence[DataFrame], keys: Sequence[str], origin: str) -> DataFrame:
    """Ranks the breakouts of each origin (one of the keys) by predicted gain in opportunity.

    current: (keys, breakout, opportunity, opportunity_low, opportunity_high, supply, supply_low, supply_high); axes: two
    frames of (keys, predicted, low, high). Bounds are those of the worst and best case, and hold their points.
    """
    two = [df.select(*keys, *(F.col(c).alias(f"_{c}{i}") for c in ("predicted", "low", "high"))) for i, df in enumerate(axes)]
    own = current.where("breakout and opportunity is not null and opportunity_low is not null and opportunity_high is not null").join(two[0], list(keys)).join(two[1], list(keys))
    mean = lambda c: (F.col(f"_{c}0") + F.col(f"_{c}1")) / 2
    own = own.withColumn("predicted", mean("predicted") - F.col("supply"))
    own = own.withColumn("low", F.least("predicted", mean("low") - F.col("supply_high"))).withColumn("high", F.greatest("predicted", mean("high") - F.col("supply_low")))
    own = own.withColumn("gain", F.col("predicted") - F.col("opportunity"))
    own = own.withColumn("gain_low", F.least("gain", F.col("low") - F.col("opportunity_high"))).withColumn("gain_high", F.greatest("gain", F.col("high") - F.col("opportunity_low")))
    return own.select(*keys, F.row_number().over(Window.partitionBy(origin).orderBy(F.col("gain").desc(), *keys)).alias("place"), "predicted", "low", "high", "gain", "gain_low", "gain_high")
