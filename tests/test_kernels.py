"""Properties of the kernels, and worked examples."""

import datetime
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions import texts as T

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
COUNTS = st.lists(st.integers(0, 500), min_size=1, max_size=12)


def frame(spark, counts, families=1):
    return spark.createDataFrame([(0, i, i % families, None if c is None else float(c)) for i, c in enumerate(counts)], "week int, genre int, family int, x double")


@FEW
@given(st.lists(st.one_of(st.none(), st.floats(-1e3, 1e3)), min_size=1, max_size=12))
def test_zscores_sum_to_zero_and_keep_missing(spark, xs):
    rows = K.zscores(frame(spark, xs), "x", ["week"]).collect()
    assert all((r.x is None) == (r.z is None) for r in rows)
    assert abs(sum(r.z or 0 for r in rows)) < 1e-6


@FEW
@given(COUNTS)
def test_shares_are_shrunk_towards_the_prior(spark, counts):
    rows = K.beta_binomial(frame(spark, counts), "x", ["week"]).collect()
    total, prior = sum(counts), 1 / len(counts)
    assert abs(sum(r.posterior for r in rows) - 1) < 1e-6
    for r in rows:
        assert 0 <= r.weight <= 1
        if total:
            low, high = sorted((r.x / total, prior))
            assert low - 1e-9 <= r.posterior <= high + 1e-9


@FEW
@given(COUNTS)
def test_counts_are_shrunk_towards_the_mean(spark, counts):
    mean = sum(counts) / len(counts)
    for r in K.gamma_poisson(frame(spark, counts), "x", ["week"]).collect():
        low, high = sorted((r.x, mean))
        assert low - 1e-6 <= r.posterior <= high + 1e-6


@FEW
@given(COUNTS)
def test_hierarchy_keeps_the_total(spark, counts):
    rows = K.hierarchical_beta_binomial(frame(spark, counts, 3), "x", ["week"], "family").collect()
    assert abs(sum(r.posterior for r in rows) - 1) < 1e-6
    assert all(0 <= r.weight <= 1 for r in rows)


@FEW
@given(st.lists(st.integers(0, 50), min_size=1, max_size=10))
def test_concentration_bounds(spark, xs):
    r = K.concentration(frame(spark, xs), "x", ["week"], 3, "genre").first()
    assert -1e-9 <= r.entropy <= math.log(len(xs)) + 1e-9
    assert -1e-9 <= r.hhi <= 1 + 1e-9 and -1e-9 <= r.top_share <= 1 + 1e-9
    if not sum(xs):
        assert (r.entropy, r.hhi, r.top_share) == (0, 0, 0)


def test_ewma_keeps_its_state_over_gaps(spark):
    alpha = 1 - math.exp(math.log(0.5) / 3)
    df = spark.createDataFrame([(1, 1, 4.0), (1, 2, None), (1, 3, 8.0)], "k int, t int, x double")
    out = {r.t: r.ewma for r in K.ewma(df, "x", ["k"], "t").collect()}
    assert out[1] == 4.0 and out[2] is None and abs(out[3] - (alpha * 8 + (1 - alpha) * 4)) < 1e-12


@pytest.mark.parametrize(
    ("last", "now", "before", "append", "order", "status"),
    [
        (None, (1, 1), (None, None), True, True, "first_observation"),
        ("2024-01-01", (None, 1), (1, 1), True, True, "incomplete_pair"),
        ("2024-01-01", (2, 2), (1, 1), False, True, "not_append_only"),
        ("2024-01-01", (2, 2), (1, 1), True, False, "invalid_order"),
        ("2024-01-08", (2, 2), (1, 1), True, True, "same_week_duplicate"),
        ("2023-12-25", (2, 2), (1, 1), True, True, "nonconsecutive_weeks"),
        ("2024-01-01", (0, 2), (1, 1), True, True, "counter_decrease"),
        ("2024-01-01", (1, 2), (1, 1), True, True, "valid_weekly"),
    ],
)
def test_counter_status(spark, last, now, before, append, order, status):
    lit = lambda v, kind: F.lit(v).cast(kind)
    column = K.counter_status(lit("2024-01-08", "date"), lit(last, "date"), [lit(x, "long") for x in now], [lit(x, "long") for x in before], append_only=lit(append, "boolean"), at=lit("2024-01-08 05:00:00" if order else "2024-01-01 00:00:00", "timestamp"), last_at=lit("2024-01-01 05:00:00", "timestamp"))
    assert spark.range(1).select(column).first()[0] == status


def test_jaccard_and_cosine(spark):
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")
    r = spark.range(1).select(K.jaccard(a(), a()), K.jaccard(a(1, 2), a(2, 3)), K.jaccard(F.lit(None).cast("array<int>"), a(1)), K.cosine(a(1, 0), a(0, 1)), K.cosine(a(0, 0), a(0, 1)), K.cosine(a(3, 4), a(3, 4))).first()
    assert tuple(r) == (1.0, 1 / 3, None, 0.0, 0.0, 1.0)


def test_unicode_fold(spark):
    texts = ["Ünïcode & Co._ltd", "𝐓𝐞𝐜𝐡𝐧𝐨", "STRASSE straße", "ΣΑΣ", "İx", " R&B / ﬁne ", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.unicode_fold(F.col("t"))).collect()] == ["unicode and co ltd", "techno", "strasse strasse", "σασ", "ix", "r and b fine", "", None]


def test_interval_holds_the_point(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    ci = df.agg(K.interval(F.col("x"), F.lit(50.0)).alias("ci")).first().ci
    assert (ci.lower, ci.upper) == (pytest.approx(0.5), 50.0)


def test_islands(spark):
    d = datetime.date
    df = spark.createDataFrame([("a", d(2024, 1, 1)), ("a", d(2024, 1, 8)), ("a", d(2024, 1, 22))], "k string, week date")
    assert sorted(r.run for r in K.islands(df, ["k"], "week").collect()) == [d(2024, 1, 1), d(2024, 1, 1), d(2024, 1, 22)]


def test_texts(spark):
    assert T.token_set_score("the great band", "Band, great the") == 100.0
    assert T.token_set_score("great band", "great band live") == 100.0
    assert T.token_set_score("", "x") == 0.0 and T.token_set_score(None, "x") is None
    assert T.token_set_score("abc", "abd") == pytest.approx(200 * 2 / 6)
    df = spark.createDataFrame([("https://Sub.Example.org/x?y",), ("not a url",), (None,)], "u string")
    assert [r[0] for r in df.select(T.host_in(F.col("u"), ["example.org"])).collect()] == [True, False, False]
    names = spark.createDataFrame([('say "One Two," and “Drei” and "One Two,"',), (None,)], "t string").select(T.quoted_names("t")).collect()
    assert [r[0] for r in names] == [["One Two", "Drei"], []]


def test_draws_of_tasks_are_those_of_columns(spark):
    units = [f"u/{i}" for i in range(30)]
    df = spark.createDataFrame([(u, k) for u in units for k in range(11)], "u string, k int")
    rows = {(r.u, r.k): r.n for r in df.select("u", "k", K.poisson_one(K.draw(F.col("u"), F.col("k"))).alias("n")).collect()}
    found = K.draws_of(units, 11)
    assert all(found[i, k] == rows[u, k] for i, u in enumerate(units) for k in range(11))
    many = K.draws_of(units, 4000)
    assert abs(many.mean() - 1) < 0.02 and abs(many.var() - 1) < 0.05
    # draws of one digest are as independent as others
    assert abs(np.corrcoef(many[:, ::4].ravel(), many[:, 1::4].ravel())[0, 1]) < 0.02


def test_draws_of_every_length_are_digested_together(monkeypatch):
    import hashlib

    md5 = hashlib.md5
    units = ["x" * n for n in range(70)] + ["é" * n for n in range(1, 27)] + ["", "1995-01-02/3/17"]
    want = [[np.searchsorted(K.POISSON_LEVELS, int(md5(f"{u}:{k // 4}".encode()).hexdigest()[8 * (k % 4) :][:8], 16) / 2**32, "right") for k in range(45)] for u in units]
    assert K.draws_of(units, 45).tolist() == want and K.draws_of([], 45).shape == (0, 45)
    # no digest is made alone where messages fit a block
    monkeypatch.setattr(K.hashlib, "md5", None)
    assert K.draws_of(units[:53], 45).tolist() == want[:53]


def test_resampled_cells(spark, monkeypatch):
    from tidemark.operators import metrics as M

    rows = [(i % 5 if i % 11 else None, "x" if i % 2 else "y", i, float(i % 7) if i % 13 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b string, u int, w double").repartition(3)
    out = {(r.a, r.b, r.k): r.value for r in M.resampled(df, ["a", "b"], F.col("u"), F.col("w"), 9).collect()}
    want = {}
    for (a, b, u, w), times in zip(rows, K.draws_of([str(r[2]) for r in rows], 9), strict=True):
        for k in range(9):
            want[a, b, k] = want.get((a, b, k), 0.0) + (w or 0.0) * times[k]
    assert out == want
    assert M.resampled(df.where("false"), ["a", "b"], F.col("u"), F.col("w"), 9).count() == 0


def test_resampled_sums_hold_many_cells(spark):
    from tidemark.operators import metrics as M

    # 5,000 cells that alternate: each comes out once, whatever the order and the parts
    df = spark.range(15000).select((F.col("id") % 5000).alias("a"), F.col("id").alias("u"), (F.col("id") % 3).cast("double").alias("w"))
    out = {r.a: list(r.sums) for r in M.resampled_sums(df.repartition(2), ["a"], F.col("u"), F.col("w"), 4).collect()}
    times = K.draws_of([str(u) for u in range(15000)], 4) * (np.arange(15000) % 3)[:, None]
    assert len(out) == 5000 and all(out[a] == times[a::5000].sum(axis=0).tolist() for a in range(5000))


@given(st.text("abcd é", max_size=24), st.text("abcd é", max_size=24))
@settings(max_examples=150, deadline=None)
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    assert T._common(a, b) == row[-1]
