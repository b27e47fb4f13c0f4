"""Backtests of the categories' listening and conversation, their scores, choice and what is next, over the test tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import boosting as G
from tidemark.plans import substrate as S
from tidemark.plans.catalog import query, r6, s6
from tidemark.sources.tables import settled

KEYS = ["genre", "family", "axis"]
PAIR = [*KEYS, "horizon", "origin"]


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(genre, family, axis, week, x): both axes as logarithms."""
    x = S.demand(spark, sf_dir).select("genre", "family", "week", F.ln(1 + F.col("conv")).alias("conversation"), F.ln(1 + F.col("listen")).alias("listening"))
    return x.unpivot(["genre", "family", "week"], ["conversation", "listening"], "axis", "x")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.persistent(series(spark, sf_dir), KEYS, "week", "x", [1, 2])


REC = """, x AS (SELECT genre, family, 'conversation' AS axis, week, ln(1 + conv) AS x FROM grid WHERE conv IS NOT NULL UNION ALL SELECT genre, family, 'listening', week, ln(1 + listen) FROM grid WHERE listen IS NOT NULL),
    r0 AS (SELECT *, week - CAST(7 * row_number() OVER (PARTITION BY genre, axis ORDER BY week) AS INTEGER) AS isl FROM x),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY genre, axis, isl ORDER BY week) AS INTEGER) AS training_weeks FROM r0),
    t AS (SELECT a.genre, a.family, a.axis, h.h AS horizon, a.week AS target, a.week - 7 * h.h AS origin, a.x AS actual, o.x AS ox, o.training_weeks, c.x AS cx
        FROM r a CROSS JOIN (SELECT unnest([1, 2]) AS h) h LEFT JOIN r o ON o.genre = a.genre AND o.axis = a.axis AND o.week = a.week - 7 * h.h LEFT JOIN r c ON c.genre = a.genre AND c.axis = a.axis AND c.week = a.week - 364),
    m AS (SELECT *, 'naive' AS model, ox AS predicted FROM t UNION ALL SELECT *, 'seasonal', cx FROM t),
    q AS (SELECT *, quantile_cont(actual - predicted, 0.1) OVER w AS q1, quantile_cont(actual - predicted, 0.9) OVER w AS q9 FROM m
        WINDOW w AS (PARTITION BY genre, axis, horizon, model ORDER BY CAST(target - DATE '1970-01-05' AS BIGINT) RANGE BETWEEN UNBOUNDED PRECEDING AND 7 * horizon PRECEDING)),
    rec AS (SELECT genre, family, axis, horizon, model, origin, target, training_weeks, predicted, least(predicted, predicted + coalesce(q1, 0)) AS low, greatest(predicted, predicted + coalesce(q9, 0)) AS high, actual FROM q WHERE training_weeks >= 8 AND predicted IS NOT NULL)"""
SCORED = """, p AS (SELECT a.*, abs(a.actual - a.predicted) AS e, abs(n.actual - n.predicted) AS e0 FROM rec a JOIN rec n ON n.model = 'naive' AND n.genre = a.genre AND n.axis = a.axis AND n.horizon = a.horizon AND n.origin = a.origin),
    ex AS (SELECT * FROM (SELECT n_nationkey AS genre, n_regionkey AS family FROM nation) CROSS JOIN (SELECT unnest(['conversation', 'listening']) AS axis) CROSS JOIN (SELECT unnest([1, 2]) AS horizon) CROSS JOIN (SELECT unnest(['naive', 'seasonal']) AS model)),
    g AS (SELECT genre, family, axis, horizon, model, count(e) AS origins, avg(e) AS mae, avg(e0) AS naive_mae, avg(CASE WHEN low <= actual AND actual <= high THEN 1.0 WHEN e IS NOT NULL THEN 0.0 END) AS coverage, avg(high - low) AS width FROM ex LEFT JOIN p USING (genre, family, axis, horizon, model) GROUP BY 1, 2, 3, 4, 5),
    fm AS (SELECT family, axis, horizon, model, count(*) AS origins, avg(e) AS mae, avg(e0) AS naive_mae, avg(CASE WHEN low <= actual AND actual <= high THEN 1.0 ELSE 0.0 END) AS coverage, avg(high - low) AS width FROM p GROUP BY 1, 2, 3, 4)"""
STATE = "CASE WHEN naive_mae IS NULL THEN 'missing' WHEN naive_mae > 1e-12 THEN 'scored' ELSE 'zero_naive_scale' END"
MASE = "CASE WHEN naive_mae > 1e-12 THEN mae / naive_mae END"
SHOWN = f"origins, {s6('mae')} AS mae, {s6('naive_mae')} AS naive_mae, {s6(MASE)} AS mase, {s6('coverage')} AS coverage, {s6('width')} AS width, {STATE} AS status"


@query(S.sql("grid", REC + f" SELECT genre, axis, horizon, model, origin, target, training_weeks, {s6('predicted')} AS predicted, {s6('low')} AS low, {s6('high')} AS high, {s6('actual')} AS actual FROM rec"))
def rolling_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive and seasonal forecasts of both axes from every origin, one and two weeks ahead."""
    return records(spark, sf_dir).select("genre", "axis", *(F.col(c) if c not in ("predicted", "low", "high", "actual") else r6(c).alias(c) for c in B.RECORD))


def scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rec = records(spark, sf_dir)
    many = lambda name, *values: F.explode(F.array(*(F.lit(v) for v in values))).alias(name)
    expected = S.categories(spark, sf_dir).select("genre", "family", many("axis", "conversation", "listening")).select("*", many("horizon", 1, 2)).select("*", many("model", "naive", "seasonal"))
    return B.scored(rec, [*KEYS, "horizon", "model"], PAIR, expected), B.scored(rec, ["family", "axis", "horizon", "model"], PAIR)


def shown(df: DataFrame) -> list:
    return ["origins", *(r6(c).alias(c) for c in ("mae", "naive_mae", "mase", "coverage", "width")), "status"]


@query(S.sql("grid", REC + SCORED + f" SELECT 'genre' AS grain, CAST(genre AS INTEGER) AS genre, family, axis, horizon, model, {SHOWN} FROM g UNION ALL SELECT 'family', NULL, family, axis, horizon, model, {SHOWN} FROM fm"))
def two_grain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, coverage and width by category and by family; categories never forecast are listed as missing."""
    fine, coarse = scores(spark, sf_dir)
    own = fine.select(F.lit("genre").alias("grain"), "genre", "family", "axis", "horizon", "model", *shown(fine))
    return own.unionByName(coarse.select(F.lit("family").alias("grain"), F.lit(None).cast("int").alias("genre"), "family", "axis", "horizon", "model", *shown(coarse)))


@query(S.sql("grid", REC + SCORED + f""", b AS (SELECT g.genre, g.axis, g.horizon, g.model, g.mase FROM (SELECT *, {MASE} AS mase FROM g) g JOIN (SELECT *, {MASE} AS mase FROM fm) f USING (family, axis, horizon, model)
      WHERE g.mase < 1 AND f.mase < 1 AND model <> 'naive')
    SELECT k.genre, k.axis, k.horizon, coalesce(b.model, 'naive') AS model, {s6('b.mase')} AS mase, CASE WHEN b.model IS NULL THEN 'no_skill' ELSE 'skill' END AS skill FROM (SELECT DISTINCT genre, axis, horizon FROM g) k LEFT JOIN b USING (genre, axis, horizon)"""))
def two_grain_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine, coarse = scores(spark, sf_dir)
    own = B.chosen(fine, coarse, [*KEYS, "horizon"], ["family", "axis", "horizon"])
    return own.select("genre", "axis", "horizon", "model", r6("mase").alias("mase"), "skill")


@query(None)
def ets_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damped trend from every origin, beside naive: no SQL; tested against a fit of every origin by itself."""
    df = series(spark, sf_dir)
    rec = B.persistent(df, KEYS, "week", "x", [1, 2]).unionByName(B.damped(df, KEYS, "week", "x", [1, 2]))
    out = B.scored(rec, [*KEYS, "horizon", "model"], PAIR)
    return out.select("genre", "axis", "horizon", "model", *shown(out))


def cuts(df: DataFrame, every: int) -> list:
    """Mondays `every` weeks apart from the first week of a series on, those within it: one small job."""
    first, last = df.agg(F.min("week"), F.max("week")).first()
    return [] if first is None else [first + datetime.timedelta(days=7 * i) for i in range(every, (last - first).days // 7, every)]


def pooled(spark: SparkSession, sf_dir: str, horizons: list[int], every: int) -> tuple[DataFrame, DataFrame]:
    """Backtest records of naive, seasonal, smoothing and boosting."""
    # a row for each category, axis and week: every model and every job of the fit would count the posts again
    df, _ = settled(series(spark, sf_dir), "series")
    # as files, small tables are read in few tasks
    examples, _ = settled(B.pooled_examples(df, *KEYS, "week", "x", horizons), "series-examples")
    boosted = B.boosted(examples, cuts(df, every), KEYS, "axis", rounds=8)
    # series are few bytes and much work: a given number of parts is not joined into fewer
    dealt = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *KEYS)
    return df, B.persistent(dealt, KEYS, "week", "x", horizons).unionByName(B.smoothed(dealt, KEYS, "week", "x", horizons, refit=52)).unionByName(boosted)


@query(None)
def model_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All models from every origin, scored by category beside naive, and the one chosen at both grains: no SQL; each model
    is tested against plain loops. Boosting is fitted once a year, on all categories."""
    _, rec = pooled(spark, sf_dir, [1, 2], 52)
    # settled before they are paired: both sides would be forecast anew
    rec, _ = settled(rec, "records")
    rec = B.paired(rec, PAIR).persist()
    fine, coarse = B.scored(rec, [*KEYS, "horizon", "model"], PAIR), B.scored(rec, ["family", "axis", "horizon", "model"], PAIR)
    best = B.chosen(fine, coarse, [*KEYS, "horizon"], ["family", "axis", "horizon"]).select("genre", "axis", "horizon", F.col("model").alias("_best"))
    out = fine.join(best, ["genre", "axis", "horizon"])
    return out.select("genre", "axis", "horizon", "model", *shown(out), (F.col("model") == F.col("_best")).alias("chosen"))


HALF = """ , l AS (SELECT *, ln(1 + conv) AS x FROM grid WHERE conv IS NOT NULL),
    y AS (SELECT a.genre, a.week, a.x AS lag, b.x AS y FROM l a JOIN l b ON b.genre = a.genre AND b.week = a.week + 7),
    e AS (SELECT list_distinct(quantile_disc(lag, [0.25, 0.5, 0.75])) AS edges, quantile_disc(y, 0.5) AS half FROM y)"""


@query(S.sql("grid", HALF + " SELECT CAST(1 + len(list_filter(edges, lambda q: q < lag)) AS INTEGER) AS bin, count(*) AS n, CAST(count(*) FILTER (WHERE y < half) AS BIGINT) AS below FROM y, e GROUP BY 1"))
def boosting_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first histogram of the median's first tree: examples of next week's conversation by quartile of this week's, and
    those below the median."""
    x = S.grid(spark, sf_dir).where("conv is not null").select("genre", "week", F.ln(1 + F.col("conv")).alias("lag"))
    rows = x.join(x.select("genre", F.date_sub("week", 7).alias("week"), F.col("lag").alias("y")), ["genre", "week"])
    edges = rows.agg(F.percentile_approx("lag", [0.25, 0.5, 0.75], 1_000_000).alias("edges"), F.percentile_approx("y", 0.5, 1_000_000).alias("half"))
    state = rows.crossJoin(F.broadcast(edges)).select(F.lit(1).alias("node"), (F.col("y") < F.col("half")).alias("below"), F.array((F.size(F.filter(F.array_distinct("edges"), lambda q: q < F.col("lag"))) + 1)).alias("codes"))
    return G.histogram(state, ["node"]).select("bin", "n", "below")
