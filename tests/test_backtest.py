"""Backtests on short series, against plain computations."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import smoothing as E
from tidemark.operators import backtest as B
from tidemark.operators import forecast as P

FIRST = datetime.date(2024, 1, 1)


def monday(i):
    return FIRST + datetime.timedelta(days=7 * i)


def series(spark, **values):
    rows = [(g, monday(i), x) for g, xs in values.items() for i, x in enumerate(xs) if x is not ...]
    return spark.createDataFrame(rows, "genre string, week date, x double")


def wave(n):
    return [2 + 0.1 * i + (0.5 if i % 2 else -0.5) for i in range(n)]


def test_naive_against_loops(spark):
    x = wave(9) + [...] + wave(10)
    x[3] = None
    got = {r.origin: r for r in B.persistent(series(spark, a=x), ["genre"], "week", "x", [1], season=4, minimum=3).where("model = 'naive'").collect()}
    want = {}
    for o in range(len(x) - 1):
        have = lambda i: x[i] is not None and x[i] is not ...
        run = 0
        while o - run >= 0 and have(o - run):
            run += 1
        if run >= 3 and have(o + 1):
            errors = [x[i + 1] - x[i] for i in range(o) if have(i) and have(i + 1)]
            q = np.quantile(errors, [0.1, 0.9])
            want[monday(o)] = (run, x[o], min(x[o], x[o] + q[0]), max(x[o], x[o] + q[1]), x[o + 1])
    assert set(got) == set(want)
    for origin, w in want.items():
        r = got[origin]
        assert (r.training_weeks, r.predicted, r.actual) == (w[0], w[1], w[4]) and (r.low, r.high) == pytest.approx(w[2:4])


def test_damped_equals_a_fit_of_every_origin(spark):
    x = wave(14)
    got = {(r.origin, r.horizon): r for r in B.damped(series(spark, a=x, b=[1.0] * 5), ["genre"], "week", "x", [1, 2]).collect()}
    assert len(got) == 6 + 5
    for o in range(7, 13):
        y = np.array(x[: o + 1])
        ahead, level, trend = B.damped_paths(y)
        g = int(np.argmin(((y[:, None] - ahead)[1:] ** 2).sum(axis=0)))
        r = got[monday(o), 1]
        assert r.predicted == pytest.approx(level[-1, g] + B.GRID[g][2] * trend[-1, g]) and r.training_weeks == o + 1
        assert r.low <= r.predicted <= r.high and r.actual == x[o + 1]


def test_scores_choice_and_missing(spark):
    kinds = "genre string, family int, model string, origin int, predicted double, low double, high double, actual double"
    rows = [("a", 1, m, o, p, p - 1, p + 1, 10.0) for m, ps in (("naive", (8.0, 12.0)), ("ets", (9.0, 10.5)), ("seasonal", (1.0, 20.0))) for o, p in enumerate(ps)]
    rows += [("b", 1, "naive", 0, 10.0, 9.0, 11.0, 10.0), ("b", 1, "ets", 0, 10.0, 9.0, 11.0, 10.0), ("c", 1, "ets", 0, 10.0, 9.0, 11.0, 10.0)]
    rec = spark.createDataFrame(rows, kinds)
    expected = rec.select("genre", "family", "model").distinct()
    fine = B.scored(rec, ["genre", "family", "model"], ["genre", "origin"], expected)
    got = {(r.genre, r.model): r for r in fine.collect()}
    assert (got["a", "ets"].mae, got["a", "ets"].mase, got["a", "ets"].coverage, got["a", "ets"].width) == (0.75, 0.375, 1.0, 2.0)
    assert got["a", "naive"].coverage == 0.0 and got["a", "seasonal"].mase > 1
    assert got["b", "ets"].status == "zero_naive_scale" and got["b", "ets"].mase is None
    assert got["c", "ets"].status == "missing" and got["c", "ets"].origins == 0
    coarse = B.scored(rec, ["family", "model"], ["genre", "origin"])
    pick = {r.genre: (r.model, r.skill) for r in B.chosen(fine, coarse, ["genre", "family"], ["family"]).collect()}
    assert pick == {"a": ("ets", "skill"), "b": ("naive", "no_skill"), "c": ("naive", "no_skill")}
    bad = coarse.withColumn("mase", F.lit(1.0))
    assert {r.skill for r in B.chosen(fine, bad, ["genre", "family"], ["family"]).collect()} == {"no_skill"}


def test_next_up_bounds_and_breakouts_only(spark):
    now = spark.createDataFrame([("a", True, 1.0, 0.5, 1.5, 0.2, 0.1, 0.4), ("b", False, 1.0, 0.5, 1.5, 0.2, 0.1, 0.4), ("c", True, None, None, None, 0.2, 0.1, 0.4), ("d", True, 0.0, -0.5, 0.5, 0.2, 0.1, 0.4)], "genre string, breakout boolean, opportunity double, opportunity_low double, opportunity_high double, supply double, supply_low double, supply_high double")
    axis = spark.createDataFrame([(g, 2.0, 1.0, 3.0) for g in "abcd"], "genre string, predicted double, low double, high double")
    now, axis = (df.withColumn("origin", F.lit(1)) for df in (now, axis))
    got = B.next_up(now, [axis, axis], ["genre", "origin"], "origin").orderBy("place").collect()
    assert [(r.genre, r.place) for r in got] == [("d", 1), ("a", 2)]
    r = got[1]
    assert [r.predicted, r.low, r.high, r.gain, r.gain_low, r.gain_high] == pytest.approx([1.8, 0.6, 2.9, 0.8, -0.9, 2.4])


def test_features_of_an_origin(spark):
    rows = [("a", monday(0), 1.0, 5.0, [1.0, 0.0]), ("a", monday(1), 2.0, 5.0, [1.0, 0.0]), ("a", monday(3), 4.0, None, [1.0, 0.0]), ("b", monday(3), 7.0, 9.0, [0.0, 1.0]), ("c", monday(3), 8.0, 1.0, None)]
    df = spark.createDataFrame(rows, "genre string, week date, x double, opportunity double, embedding array<double>")
    out = B.features(df, "genre", "week", "x", ["opportunity"], 1, opportunity="opportunity", fallback="x", embedding="embedding", best=1)
    got = {(r.genre, r.origin): r for r in out.collect()}
    r = got["a", monday(3)]
    assert [r.target_lag_1, r.target_lag_2, r.target_lag_3, r.target_lag_4] == [4.0, None, 2.0, 1.0]
    assert (r.target_week, r.week_of_year, r.category_code, r.opportunity) == (monday(4), 5.0, 0.0, None)
    assert r.trend_similarity == 0.0 and got["b", monday(3)].trend_similarity == 1.0 and got["c", monday(3)].trend_similarity == 0.0
    assert got["a", monday(0)].trend_similarity == 1.0


def season_series(n, seed=4, cycle=52):
    """Values of the recursion itself with known parameters, and those parameters."""
    p = E.Parameters(0.35, 0.05, 0.25, 0.95)
    r = np.random.default_rng(seed)
    season = [2 * np.sin(2 * np.pi * i / cycle) + 0.5 * np.cos(6 * np.pi * i / cycle) for i in range(cycle)]
    level, trend, y = 10.0, 0.05, []
    terms = list(season)
    for i in range(n):
        base = level + p.damping * trend
        v = base + terms[i] + r.normal(0, 0.1)
        new = p.level * (v - terms[i]) + (1 - p.level) * base
        trend = p.trend * (new - level) + (1 - p.trend) * p.damping * trend
        level = new
        terms.append(p.season * (v - base) + (1 - p.season) * terms[i])
        y.append(float(v))
    return y, p


def test_smoothing_recovers_planted_parameters():
    y, p = season_series(364)
    found = E.parameters(E.fitted(y, 52))
    assert abs(found.level - p.level) < 0.12 and abs(found.season - p.season) < 0.15
    own, best = E.path(y, found, 52), E.path(y, p, 52)
    assert sum((np.array(y) - own.ahead) ** 2) <= 1.001 * sum((np.array(y) - best.ahead) ** 2)
    for h in (1, 2, 52, 60):  # the latest known cycle's term
        i = 300
        assert own.point(i, h, found.damping) == pytest.approx(own.levels[i] + own.trends[i] * sum(found.damping**k for k in range(1, h + 1)) + own.terms[i + h - (0 if h <= 52 else 52)])


def test_smoothing_backtest_equals_a_fit_of_every_origin(spark):
    y, _ = season_series(24, cycle=6)
    got = {(r.origin, r.horizon): r for r in B.smoothed(series(spark, a=y, b=[1.0] * 5), ["genre"], "week", "x", [1, 2], season=6, refit=1).collect()}
    assert len(got) == 16 + 15
    start = None
    for o in range(7, 23):
        cycle = 6 if o + 1 >= 12 else 0
        start = E.fitted(y[: o + 1], cycle, start)
        p = E.parameters(start)
        own = E.path(y[: o + 1], p, cycle)
        want = E.interval(own.point(o, 1, p.damping), np.array(y[: o + 1]) - np.array(own.ahead), 1)
        r = got[monday(o), 1]
        assert (r.predicted, r.low, r.high) == pytest.approx(want) and r.actual == y[o + 1] and r.training_weeks == o + 1


def test_season_beats_naive(spark):
    y, _ = season_series(260)
    df = series(spark, a=y)
    records = B.persistent(df, ["genre"], "week", "x", [2]).unionByName(B.smoothed(df, ["genre"], "week", "x", [2], refit=26))
    late = records.where(F.col("origin") >= F.lit(monday(120)))
    scores = {r.model: r for r in B.scored(late, ["model"], ["horizon", "origin"]).collect()}
    assert scores["ets"].mase < 0.9 and 0.65 < scores["ets"].coverage
    last = P.holt(df, ["genre"], "week", "x", 2).first()
    season = [v for i, v in enumerate(y) if i % 52 == (len(y) + 1) % 52]
    assert abs(last.predicted - season[-1]) < 1.0 and last.low <= last.predicted <= last.high


def test_models_share_one_settled_series(spark, data):
    """The posts are counted once, and no table passes through the driver for that, however many models and jobs follow."""
    from pyspark.sql import functions as F

    from tidemark.plans import backtest_queries as Q
    from tidemark.plans import substrate as S

    df, rec = Q.pooled(spark, data, [1], 10_000)
    assert df.inputFiles() and all("series-" in f for f in [*df.inputFiles(), *rec.inputFiles()])
    rows = lambda d: sorted((r.genre, r.axis, r.week, round(r.x, 9)) for r in d.where("x is not null").collect())
    of = S.grid(spark, data).select("genre", "week", F.ln(1 + F.col("conv")).alias("conversation"), F.ln(1 + F.col("listen")).alias("listening"))
    assert rows(df) == rows(of.unpivot(["genre", "week"], ["conversation", "listening"], "axis", "x"))
    plan = S.conversation(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [author" not in plan and "BroadcastHashJoin [post_id" not in plan
