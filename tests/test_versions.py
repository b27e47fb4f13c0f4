"""Fingerprints, replacement, activation, windows and cuts on literal frames."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import versions as V

D = datetime.date


def test_only_changed_keys_are_replaced(spark):
    make = lambda rows: spark.createDataFrame(rows, "artist string, tag string")
    old = make([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z"), ("e", None)])
    new = make([("a", "y"), ("a", "x"), ("a", "x"), ("b", "w"), ("d", None), ("e", None)])
    change = V.changed_keys(V.fingerprinted(new, ["artist"], ["tag"]), V.fingerprinted(old, ["artist"], ["tag"]), ["artist"])
    assert {(r.artist, r.change) for r in change.collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    got = sorted(map(tuple, V.replace_keys(old, new, change, ["artist"]).collect()), key=str)
    assert got == [("a", "x"), ("a", "y"), ("b", "w"), ("d", None), ("e", None)]
    none = make([])
    assert V.changed_keys(V.fingerprinted(none, ["artist"], ["tag"]), V.fingerprinted(none, ["artist"], ["tag"]), ["artist"]).count() == 0


def test_one_active_version_of_a_kind(spark):
    table = spark.createDataFrame([("m", "v1", True, D(2024, 1, 1)), ("b", "v1", True, D(2024, 1, 1))], "kind string, version string, active boolean, activated_at date")
    at = F.lit("2024-02-01")
    once = V.activated(table, "v2", "m", at)
    state = lambda df: sorted((r.kind, r.version, r.active) for r in df.collect())
    assert state(once) == [("b", "v1", True), ("m", "v1", False), ("m", "v2", True)]
    assert state(V.activated(V.activated(once, "v1", "m", at), "v1", "m", at)) == [("b", "v1", True), ("m", "v1", True), ("m", "v2", False)]


@pytest.mark.parametrize("day, first, last", [("2024-01-08", "2023-12-25", "2024-01-07"), ("2024-01-14", "2023-12-25", "2024-01-07"), ("2024-01-15", "2024-01-01", "2024-01-14")])
def test_window_ends_on_a_closed_sunday(spark, day, first, last):
    w = spark.range(1).select(V.closed_window(F.lit(day)).alias("w")).first().w
    assert (str(w["from"]), str(w["to"])) == (first, last)
    with pytest.raises(ValueError):
        V.closed_window(F.lit(day), 0)


def test_thirds_and_common_keys(spark):
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate([1.0, 2.0, 2.0, 3.0, 5.0, 9.0, None])] + [("h", 9, 4.0), ("n", 10, None)], "g string, k int, x double")
    got = {(r.g, r.k): r.third for r in V.cut_in_three(df, "x", ["g"], ["k"]).collect()}
    assert [got["g", i] for i in range(7)] == ["low", "middle", "middle", "middle", "high", "high", None]
    assert got["h", 9] == "high" and got["n", 10] is None
    key = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    assert [r.k for r in V.common_keys([key(1, 1, 2), key(1, 2), key(1), key(1, 3)], ["k"]).collect()] == [1]


def test_routes_at_the_latest_week(spark):
    from tidemark.operators import reads as A

    rows = spark.createDataFrame([(1, 1, D(2024, 1, 1), "ready"), (1, 1, D(2024, 1, 8), "ready"), (2, 1, D(2024, 1, 8), "unsupported")], "genre int, family int, week date, state string")
    assert [(r.genre, r.week) for r in A.coverage(rows).collect()] == [(1, D(2024, 1, 8)), (2, D(2024, 1, 8))]
    assert [r.genre for r in A.coverage(rows, state="unsupported").collect()] == [2]
    assert A.coverage(rows, week=D(2024, 1, 1)).count() == 1 and A.coverage(rows.limit(0)).count() == 0
    assert A.macro_families(rows.where("genre = 1"), weeks=1).first().week == D(2024, 1, 8)
    with pytest.raises(ValueError):
        A.macro_families(rows, weeks=0)
