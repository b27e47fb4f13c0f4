"""Quantile boosting against the same algorithm in plain loops, and on planted shapes."""

import datetime

import numpy as np
import pytest

from tidemark.operators import backtest as B
from tidemark.operators import boosting as G

FIRST = datetime.date(2022, 1, 3)


def nearest(values, q):
    """The value whose rank is the least that covers q."""
    values = np.sort(values)
    return values[max(int(np.ceil(q * len(values))) - 1, 0)]


def plain_fit(x, y, q, rounds, depth, rate, bins, ridge):
    """One model, row by row: returns a function of a row."""
    edges = [np.unique([nearest(c, i / bins) for i in range(1, bins)]) if (c := col[np.isfinite(col)]).size else np.array([]) for col in x.T]
    code = lambda row: [0 if not np.isfinite(v) else 1 + sum(e < v for e in es) for v, es in zip(row, edges, strict=True)]
    codes = np.array([code(r) for r in x])
    start = nearest(y, q)
    value = np.full(len(y), start)
    trees = []
    for _ in range(rounds):

        def grow(rows, level):
            if level == depth:
                return nearest(y[rows] - value[rows], q) if len(rows) else 0.0
            best = None
            for f in range(x.shape[1]):
                for b in range(bins):
                    left = rows[codes[rows, f] <= b]
                    right = rows[codes[rows, f] > b]
                    if len(left) >= G.LEAF and len(right) >= G.LEAF:
                        s = lambda r: (q * len(r) - (y[r] < value[r]).sum()) ** 2 / (len(r) + ridge)
                        gain = s(left) + s(right) - s(rows)
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, f, b)
            if best is None or best[0] <= 1e-9:
                return (0, 1 << 30, grow(rows, level + 1), 0.0)
            _, f, b = best
            return (f, b, grow(rows[codes[rows, f] <= b], level + 1), grow(rows[codes[rows, f] > b], level + 1))

        tree = grow(np.arange(len(y)), 0)

        def at(tree, c):
            while isinstance(tree, tuple):
                tree = tree[2] if c[tree[0]] <= tree[1] else tree[3]
            return tree

        value = value + rate * np.array([at(tree, c) for c in codes])
        trees.append(tree)
    return lambda row: start + rate * sum(at(t, code(row)) for t in trees)


def test_equals_plain_boosting(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(220, 3)), 2)
    x[r.random(x.shape) < 0.1] = np.nan
    y = np.round(np.nan_to_num(x[:, 0]) * 2 + (np.nan_to_num(x[:, 1]) > 0.3) + r.normal(0, 0.3, 220), 3)
    rows = [(int(i % 2), *(None if np.isnan(v) else float(v) for v in a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    rows += [(7, 1.0, 1.0, 1.0, 1.0)] * 15 + [(8, 1.0, 1.0, 1.0, None)] * 40  # too few examples
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, y double")
    shape = {"rounds": 4, "depth": 2, "rate": 0.3, "bins": 8, "ridge": 0.1}
    model = G.fit(df, ["k"], ["a", "b", "c"], "y", **shape)
    assert set(model.trees) == {(0,), (1,)}
    found = G.forecast(df.withColumnRenamed("y", "low_"), model).collect()
    assert len(found) == 220 and {f.k for f in found} == {0, 1}
    for k in (0, 1):
        own = [plain_fit(x[k::2], y[k::2], q, **shape) for q in G.QUANTILES]
        for f in (f for f in found if f.k == k):
            want = [m(np.array([np.nan if v is None else v for v in (f.a, f.b, f.c)])) for m in own]
            assert (f.low, f.predicted, f.high) == pytest.approx((min(want), want[1], max(want)), abs=1e-9)


def test_intervals_follow_the_spread(spark):
    """Noise that grows with a feature: held-out coverage near 0.8 on both halves, no crossing, wider where noisier."""
    r = np.random.default_rng(5)
    x = r.uniform(0, 1, 1600)
    y = 3 * x + r.normal(0, 1, 1600) * (0.1 + x)
    df = spark.createDataFrame([(float(a), float(b), int(i < 1200)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y double, train int")
    model = G.fit(df.where("train = 1").selectExpr("1 as one", "*"), ["one"], ["x"], "y", rounds=20, rate=0.3)
    out = G.forecast(df.where("train = 0").selectExpr("1 as one", "*"), model).toPandas()
    assert ((out.low <= out.predicted) & (out.predicted <= out.high)).all()
    for half in (out[out.x < 0.5], out[out.x >= 0.5]):
        assert 0.68 < ((half.low <= half.y) & (half.y <= half.high)).mean() < 0.92
    width = out.high - out.low
    assert width[out.x > 0.7].mean() > 2 * width[out.x < 0.3].mean()
    assert (out.y - out.predicted).abs().mean() < (out.y - y[:1200].mean()).abs().mean()


def test_no_examples(spark):
    df = spark.createDataFrame([], "k int, a double, y double")
    model = G.fit(df, ["k"], ["a"], "y")
    assert not model.trees and G.forecast(df, model).count() == 0


def weeks(spark, n=90):
    r = np.random.default_rng(1)
    rows = []
    for g in range(6):
        level = 2.0
        for i in range(n):
            level = 0.3 * level + 0.7 * (2 + g % 2 + np.sin(2 * np.pi * i / 13))
            rows.append((f"g{g}", "f" + str(g % 2), "a", FIRST + datetime.timedelta(days=7 * i), float(level + r.normal(0, 0.05))))
    return spark.createDataFrame(rows, "genre string, family string, axis string, week date, x double")


def test_rolling_origins_learn_nothing_of_the_future(spark):
    cuts = [FIRST + datetime.timedelta(days=7 * i) for i in (40, 65)]
    df = weeks(spark)
    by = ["genre", "family", "axis"]
    run = lambda d: B.boosted(B.pooled_examples(d, *by, "week", "x", [1, 2]), cuts, by, "axis", rounds=6)
    own = {(o.genre, o.horizon, o.origin): o for o in run(df).collect()}
    assert {o[2] for o in own} == {FIRST + datetime.timedelta(days=7 * i) for i in range(40, 89)}
    assert all(o.low <= o.predicted <= o.high and o.target > o.origin for o in own.values())
    # what comes after the last cut changes no forecast from an origin before it
    changed = df.selectExpr("genre", "family", "axis", "week", f"if(week > date'{cuts[1]}', x + 50, x) as x")
    for key, o in {(o.genre, o.horizon, o.origin): o for o in run(changed).collect()}.items():
        if key[2] <= cuts[1]:
            assert (o.low, o.predicted, o.high) == (own[key].low, own[key].predicted, own[key].high)
    naive = B.persistent(df, by, "week", "x", [1, 2])
    records = naive.unionByName(run(df))
    scores = {r.horizon: r.mase for r in B.scored(records, ["model", "horizon"], [*by, "horizon", "origin"]).where("model = 'gbm'").collect()}
    assert scores[2] < 1  # turning points are learned from the pool


def test_few_examples_need_no_passes(spark):
    """Models of few examples are grown within tasks, the same as by passes; those of many in tasks that their examples are
    worth, however many parts they come in."""
    r = np.random.default_rng(8)
    rows = [(i % 3, float(a), float(b), float(2 * a + (b > 0.5) + r.normal(0, 0.2))) for i, (a, b) in enumerate(r.normal(size=(900, 2)))]
    df = spark.createDataFrame(rows, "k int, a double, b double, y double").repartition(12)
    tracker = spark.sparkContext.statusTracker()
    done = lambda: set(tracker.getJobIdsForGroup(None))
    shape = {"rounds": 3, "depth": 2}
    before = done()
    one = G.fit(df, ["k"], ["a", "b"], "y", **shape)
    jobs = len(done() - before)
    assert jobs <= 8, jobs  # stages may be jobs of their own
    many = G.fit(df, ["k"], ["a", "b"], "y", **shape, whole=0)
    mixed = G.fit(df.where("k <> 1 or a > 0"), ["k"], ["a", "b"], "y", **shape, whole=200)
    assert set(one.trees) == set(many.trees) == set(mixed.trees) == {(0,), (1,), (2,)}
    for a, b, keys in ((one, many, [(0,), (1,), (2,)]), (one, mixed, [(0,), (2,)])):
        for key in keys:
            for x, y in zip(a.trees[key], b.trees[key], strict=True):
                assert len(x) == len(y) == 3
                for s, t in zip(x, y, strict=True):
                    assert (s.feature == t.feature).all() and (s.edge == t.edge).all() and s.leaf == pytest.approx(t.leaf, abs=1e-12)
