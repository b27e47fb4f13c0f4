"""Coverage on worked examples: one week's evidence of a few sources."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import coverage as C

D = datetime.datetime
FEW = C.Thresholds(lookback_weeks=4, artists=1, valid_artists=1, posts=1, attempts=1, resolution_rate=0.5, overlap_artists=1, overlap_rate=0.1)


def found(spark, **other):
    make = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    out = {
        "tags": make([("Techno ", D(2024, 1, 8)), ("garage", D(2024, 1, 8)), (None, D(2024, 1, 8))], "tag string, at timestamp"),
        "artists": make([("Ann", "X1", ["techno"], 10, 100, D(2024, 1, 2)), ("Ann", "x1", ["techno"], 11, 120, D(2024, 1, 9)), ("Bo", None, ["techno", "garage"], 9, 9, D(2024, 1, 2)), ("Bo", None, ["techno"], 8, 10, D(2024, 1, 9)), ("Cy", None, None, 1, 1, D(2024, 1, 9))], "name string, id string, labels array<string>, listeners long, plays long, at timestamp"),
        "releases": make([("r1", D(2024, 1, 10), ["techno"], "ann", None, D(2024, 1, 11)), ("r2", None, ["techno"], "Bo", None, D(2024, 1, 11))], "release string, released timestamp, labels array<string>, name string, id string, at timestamp"),
        "posts": make([("p1", D(2024, 1, 9), D(2024, 1, 9)), ("p2", D(2024, 1, 9), D(2024, 1, 9)), ("p3", D(2024, 1, 9), D(2024, 1, 9))], "post string, created_at timestamp, at timestamp"),
        "links": make([("p1", "Ann", None, "name", 99.0, D(2024, 1, 9)), ("p1", "Bo", None, "mbid", 1.0, D(2024, 1, 10)), ("gone", "Bo", None, "name", 1.0, D(2024, 1, 10))], "post string, name string, id string, kind string, score double, at timestamp"),
        "ambiguities": make([("p1", "Ann", None, D(2024, 1, 9)), ("p2", "BO", None, D(2024, 1, 9)), ("p3", "nobody", None, D(2024, 1, 9))], "post string, name string, id string, at timestamp"),
    }
    return out | other


def cells(spark, sources, t=FEW, as_of="2024-01-15 00:00:00", **more):
    categories = spark.createDataFrame([(1, "techno"), (2, "UK garage"), (3, "US garage")], "genre int, name string")
    labels = spark.createDataFrame([("Techno", 1), ("techno", 1), ("garage", 2), ("Garage", 3), ("us garage", 3), (None, 3), ("", 2)], "label string, genre int")
    df = C.coverage(categories, labels, sources, t, F.lit(as_of).cast("timestamp"), **more)
    return {(r.genre, str(r.week)): r for r in df.collect()}


def test_counts_overlap_history_and_rungs(spark):
    got = cells(spark, found(spark))
    assert {w for _, w in got} == {"2024-01-01", "2024-01-08"} and len(got) == 6
    r = got[1, "2024-01-08"]
    # an ambiguous alias names no category; an id meets its name; a post's link by id wins and its ambiguity is ignored
    assert (r.tags, r.artists, r.valid_artists, r.releases, r.posts, r.attempts, r.history) == (1, 2, 1, 1, 1, 2, 2)
    assert r.resolution_rate == 0.5 and (r.overlap_artists, r.overlap_rate) == (2, 1.0)
    assert r.latest == D(2024, 1, 11) and not r.stale and r.state == "ready"
    first = got[1, "2024-01-01"]
    assert (first.artists, first.valid_artists, first.posts, first.history) == (2, None, None, 1) and first.state == "collecting_history"
    assert first.overlap_artists is None and first.resolution_rate is None
    empty = got[2, "2024-01-08"]
    assert empty.stale and empty.state == "unsupported" and empty.tags is None and empty.history is None


def test_ambiguities_date_their_own_categories(spark):
    # two names of one post: each one's date belongs to its own categories
    sources = found(spark)
    artists = spark.createDataFrame([("Ann", "x1", ["techno"], 1, 1, D(2024, 1, 8)), ("Bo", None, ["us garage"], 1, 1, D(2024, 1, 8))], sources["artists"].schema)
    doubt = spark.createDataFrame([("p2", "Ann", None, D(2024, 1, 10)), ("p2", "Bo", None, D(2024, 1, 12)), ("p2", "Ann", None, D(2024, 1, 9))], sources["ambiguities"].schema)
    got = cells(spark, sources | {"artists": artists, "ambiguities": doubt, "releases": sources["releases"].limit(0), "links": sources["links"].limit(0)})
    assert [(got[g, "2024-01-08"].attempts, got[g, "2024-01-08"].latest) for g in (1, 3)] == [(1, D(2024, 1, 10)), (1, D(2024, 1, 12))]


def test_coverage_is_counted_once_for_all_reads(spark, tmp_path):
    # the report and its latest week read finished cells: what the sources are read from may be gone
    import shutil

    from tidemark.operators import reads as A

    place = {n: f"{tmp_path}/{n}" for n in found(spark)}
    for n, df in found(spark).items():
        df.write.parquet(place[n])
    categories, labels = spark.createDataFrame([(1, "techno")], "genre int, name string"), spark.createDataFrame([("techno", 1)], "label string, genre int")
    df = C.coverage(categories, labels, {n: spark.read.parquet(p) for n, p in place.items()}, FEW, F.lit("2024-01-15 00:00:00").cast("timestamp"))
    for p in place.values():
        shutil.rmtree(p)
    assert [(r.genre, r.posts) for r in A.coverage(df).collect()] == [(1, 1)]


@pytest.mark.parametrize("change, state", [({"artists": 3}, "insufficient_listening"), ({"posts": 2}, "insufficient_conversation"), ({"releases": 2}, "insufficient_supply"), ({"resolution_rate": 0.6}, "insufficient_resolution"), ({"overlap_artists": 3}, "insufficient_resolution"), ({"max_age_days": 3}, "unsupported")])
def test_each_threshold(spark, change, state):
    t = C.Thresholds(**{**FEW.__dict__, **change})
    assert cells(spark, found(spark), t)[1, "2024-01-08"].state == state


def test_unfit_lookback_and_empty(spark):
    got = cells(spark, found(spark), C.Thresholds(**{**FEW.__dict__, "lookback_weeks": 1}), unfit=F.col("genre") == 1)
    # history counts weeks before the lookback too
    assert set(got) == {(g, "2024-01-08") for g in (1, 2, 3)} and got[1, "2024-01-08"].state == "unsupported" and got[1, "2024-01-08"].history == 2
    assert cells(spark, {k: df.limit(0) for k, df in found(spark).items()}) == {}
    with pytest.raises(ValueError):
        C.week_range(None, 4, start=datetime.date(2024, 1, 2))
