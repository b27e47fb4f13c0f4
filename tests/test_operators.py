"""Relational operators, sources, publishing, forecasts and streams on small frames."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast as P
from tidemark.operators import metrics as M
from tidemark.operators import reads as A
from tidemark.operators import relational as R
from tidemark.operators import resolve as E
from tidemark.sources import tables as X
from tidemark.streaming import ingest as I

MONDAY = datetime.date(2024, 1, 1)


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "name"), (2, "b", "name")], "k int, v string, kind string")
    new = spark.createDataFrame([(1, "x", "mbid"), (2, "y", "name"), (3, "z", "name")], "k int, v string, kind string")
    assert values(R.upsert(old, new, ["k"])) == [(1, "x", "mbid"), (2, "y", "name"), (3, "z", "name")]
    assert values(R.upsert(old, new, ["k"], F.col("kind") == "mbid")) == [(1, "x", "mbid"), (2, "b", "name"), (3, "z", "name")]
    assert values(R.insert_absent(old, new, ["k"])) == [(1, "a", "name"), (2, "b", "name"), (3, "z", "name")]


def test_fallback_to_legacy(spark):
    rows = spark.createDataFrame([("v1", 1)], "version string, x int")
    legacy = spark.createDataFrame([(9,)], "x int")
    versions = lambda active: spark.createDataFrame([("v1", active)], "version string, active boolean")
    assert values(R.active_or_legacy(rows, versions(True), legacy)) == [(1,)]
    assert values(R.active_or_legacy(rows, versions(False), legacy)) == [(9,)]


def test_pages(spark):
    df = spark.range(10)
    assert [r.id for r in R.page(df, [F.col("id").desc()], 3, 2).collect()] == [7, 6, 5]
    with pytest.raises(ValueError):
        R.page(df, [F.col("id")], 201)
    assert A.state(A.cursor({"offset": 3})) == {"offset": 3}
    assert A.has_more([1, 2, 3], 2) == ([1, 2], True)
    with pytest.raises(ValueError):
        A.monday(datetime.date(2024, 1, 2), datetime.date(2024, 2, 1))


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    assert R.fingerprint(a, []).first() == R.fingerprint(a.orderBy(F.col("k").desc()), []).first()
    assert R.fingerprint(a, []).first() != R.fingerprint(a.where("k = 1"), []).first()


def test_publish_only_without_violations(spark, tmp_path):
    rows, path = spark.createDataFrame([(1,)], "x int"), str(tmp_path / "t")
    assert not M.publish(rows, path, "v1", spark.createDataFrame([(0, 2)], "a int, b int"))
    none = spark.createDataFrame([(0, 0)], "a int, b int")
    assert M.publish(rows, path, "v1", none) and M.publish(rows.unionAll(rows), path, "v2", none) and M.publish(rows, path, "v1", none)
    assert values(spark.read.parquet(path).groupBy("version").count()) == [("v1", 1), ("v2", 2)]


def test_promotion(spark):
    week = lambda *d: spark.createDataFrame([(x,) for x in d], "week date")
    as_of = F.lit("2024-01-20").cast("date")
    assert M.promotion(week(MONDAY, datetime.date(2024, 1, 15)), week(), as_of).first().promote
    assert not M.promotion(week(MONDAY), week(MONDAY), as_of).first().promote
    assert not M.promotion(week(), week(), as_of).first().promote


def test_checkpoint_units(spark):
    schema = X.SCHEMAS["checkpoints"]
    done = spark.createDataFrame([("s", "r", "window", "u", '{"from":"2024-01-01","to":"2024-01-14"}')], schema)
    again = spark.createDataFrame([("s", "r", "window", "u", "{}"), ("s", "r", "completed", "u", None)], schema)
    units, conflicts = X.checkpoint_units(done, again)
    assert units.count() == 2 and values(conflicts) == [("s", "r", "window", "u")]
    assert values(X.completed_windows(units)) == [("r", datetime.date(2024, 1, 1), datetime.date(2024, 1, 14))]


def test_json_side_output(spark):
    raw = spark.createDataFrame([('{"a": 1}',), ("{broken",), (None,)], "value string")
    rows, bad = X.parsed(raw, "a int")
    assert values(rows) == [(1,)] and bad.count() == 2


def test_dates_need_their_full_shape(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2024-02-30",), ("2024",), ("2024-02",), (None,)], "d string")
    assert [r[0] for r in df.select(X.full_date(F.col("d"))).collect()] == [datetime.date(2024, 2, 29), None, None, None, None]


def test_resolution(spark):
    ev = spark.createDataFrame([("a", "rock", 2.0), ("a", "odd", 5.0), ("b", "odd", 1.0)], "artist string, tag string, w double")
    mp = spark.createDataFrame([("rock", 1, 1.0, 0.8)], "tag string, genre int, weight double, confidence double")
    assert values(E.artist_memberships(ev, mp)) == [("a", 1, 1.0, 0.8), ("b", None, 1.0, None)]
    df = spark.createDataFrame([("x", True, True), ("x", True, False), ("x", False, True), ("x", None, True)], "s string, p boolean, a boolean")
    assert values(E.agreement(df, ["s"], "p", "a")) == [("x", 1, 1, 1, 0.5, 0.5)]


def series(n, f):
    return [("g", MONDAY + datetime.timedelta(weeks=i), float(f(i))) for i in range(n)]


def test_holt_beats_persistence_on_a_trend(spark):
    rows = series(40, lambda i: 2 * i + (-1) ** i)
    df = spark.createDataFrame(rows, "g string, week date, x double")
    r = P.holt(df, ["g"], "week", "x", 2).first()
    truth = 2 * 41
    assert abs(r.predicted - truth) < abs(rows[-1][2] - truth) and r.low <= r.predicted <= r.high
    assert P.holt(df.limit(5), ["g"], "week", "x", 2).count() == 0


def test_constant_series_have_no_skill(spark):
    df = spark.createDataFrame(series(12, lambda i: 0), "g string, week date, x double")
    naive = P.naive(df, ["g"], "week", "x", 1)
    scored = P.scores(naive, naive, ["g"], ["g", "origin", "target"])
    assert scored.first().mase is None
    assert values(P.selected(scored.withColumn("model", F.lit("m")), ["g"])) == [("g", "naive", "no_skill")]


def test_lags_go_by_the_calendar_and_never_ahead(spark):
    rows = [r for i, r in enumerate(series(8, lambda i: i)) if i != 5]
    lag = lambda rows: {r.week: r.x_lag_1 for r in P.lags(spark.createDataFrame(rows, "g string, week date, x double"), ["g"], "week", "x", [1]).collect()}
    out = lag(rows)
    assert out[MONDAY + datetime.timedelta(weeks=6)] is None and out[MONDAY + datetime.timedelta(weeks=7)] == 6.0
    changed = lag([*rows[:-1], (*rows[-1][:2], 99.0)])
    assert all(changed[w] == v for w, v in out.items())


def test_maturity_needs_every_post(spark):
    grid = spark.createDataFrame([(MONDAY, 1), (MONDAY, 2), (MONDAY, 3)], "week date, genre int")
    posts = spark.createDataFrame([(MONDAY, 1, True), (MONDAY, 1, False), (MONDAY, 2, True)], "week date, genre int, mature boolean")
    pairs = spark.createDataFrame([(MONDAY, 2, "valid_weekly")], "week date, genre int, status string")
    windows = spark.createDataFrame([(MONDAY, MONDAY + datetime.timedelta(days=6))], "`from` date, `to` date")
    out = {r.genre: r.state for r in M.axis_maturity(grid, posts, pairs, windows).collect()}
    assert out == {1: "conversation_pending", 2: "complete", 3: "conversation_pending"}


def test_stream_equals_batch_and_restarts_empty(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.withColumn("day", F.to_date("ts")).repartition(3, "day").drop("day").write.json(str(tmp_path / "in"))
    for _ in range(2):
        stream = I.classified(I.file_stream(spark, str(tmp_path / "in")))
        I.write(stream, str(tmp_path / "state"), I.append_once(str(tmp_path / "out"))).awaitTermination()
        out = spark.read.parquet(str(tmp_path / "out")).drop("batch")
        assert values(out.select("event_id", "user_id")) == values(I.classified(events).select("event_id", "user_id"))


def test_weeks_of_streams_begin_on_mondays(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    weeks = [r.week for r in I.weekly(events).select("week").distinct().collect()]
    assert weeks and all(w.weekday() == 0 for w in weeks)


def test_cycles_of_any_length(spark):
    rows = [(1, None, "a"), (2, 1, "b"), (3, 5, "c"), (4, 3, "d"), (5, 4, "e"), (6, 3, "f"), (7, 7, "g"), (8, 99, "h")]
    faults = E.taxonomy_faults(spark.createDataFrame(rows, "id int, parent int, name string"))
    assert values(faults) == sorted([("cycle", "3"), ("cycle", "4"), ("cycle", "5"), ("cycle", "7"), ("missing parent", "8")], key=str)
    assert values(E.taxonomy_faults(spark.createDataFrame(rows[:2], "id int, parent int, name string"))) == []


def test_scene_tells_opposites_apart(spark):
    points = [("a", [3.0, 0.1, 0.0]), ("b", [-3.0, 0.0, 0.1]), ("c", [0.1, 1.0, 0.0]), ("d", [0.0, -1.0, 0.0])]
    at = {r.genre: (r.x, r.y) for r in E.scene(spark.createDataFrame(points, "genre string, centroid array<double>")).collect()}
    assert at["a"][0] > 2.9 and at["b"][0] < -2.9 and at["c"][1] > 0.9 and at["d"][1] < -0.9
    assert E.scene(spark.createDataFrame(points[:2], "genre string, centroid array<double>")).count() == 0


def test_receipts_and_manifest(spark):
    from tidemark.operators import evidence as V

    rows = spark.createDataFrame([(MONDAY, 1, i % 5) for i in range(9)], "week date, genre int, post_id int")
    long = V.receipts(rows, "post_id")
    assert long.count() == 5 and values(V.receipt_lists(long, "post_id", 3)) == [(MONDAY, 1, [0, 1, 2], 5)]
    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    runs = spark.createDataFrame([("x", at(1, 12), at(3, 6)), ("y", at(2, 0), at(2, 1))], "run_id string, started_at timestamp, finished_at timestamp")
    events = spark.createDataFrame([(at(1, 11),), (at(1, 12),), (at(2, 0),), (at(2, 0),), (at(3, 6),)], "at timestamp")
    out = V.manifest(runs, runs.where("run_id = 'y'"), {"events": events})
    assert values(out.select("run_id", "events")) == [("x", 3), ("y", 2)]


def test_music_rules(spark):
    from tidemark.operators import classify as C

    cases = [
        ("new song", ["https://x.bandcamp.com/a", "https://soundcloud.com/b"], None, ["link:bandcamp.com", "link:soundcloud.com"]),
        ("look", ["https://NHL.com]", "https://mybandcamp.com", None], None, []),
        ("#NowPlaying x #nowplaying", [], ["#NewMusic"], ["hashtag:#newmusic", "hashtag:#nowplaying"]),
        ("No problem #np", None, None, []),
        ("a#np b", None, None, []),
        ("Listening  to it, ON REPEAT", None, None, ["intent:listening_to", "intent:on_repeat"]),
        ("she's a new single", None, None, []),
        ("a new single, just dropped", None, None, ["intent:new_single", "intent:just_dropped"]),
        ("just dropped the ball", None, None, []),
        (None, None, None, []),
    ]
    df = spark.createDataFrame([(i, t, x, h) for i, (t, x, h, _) in enumerate(cases)], "i int, text string, links array<string>, given array<string>")
    found = df.select("i", C.rules(F.col("text"), F.col("links"), C.tags(F.col("text"), F.col("given"))).alias("r")).orderBy("i").collect()
    assert [x.r for x in found] == [c[3] for c in cases]


def test_feed(spark):
    from tidemark.operators import classify as C

    cases = [("x", ["link:last.fm"], True), ("a song", ["link:youtu.be"], True), ("a songbird", ["link:youtu.be"], False), ("A - B", ["hashtag:#np"], False), ("Ab - Bc", ["hashtag:#np"], True), ("x #music", ["hashtag:#np"], True), ("listening to The Band", ["intent:listening_to"], True), ("listening to rain", ["intent:listening_to"], False), (None, ["link:youtube.com"], False), ("x", [], False)]
    df = spark.createDataFrame([(i, t, r) for i, (t, r, _) in enumerate(cases)], "i int, text string, rules array<string>")
    assert [x.f for x in df.select("i", C.in_feed(F.col("text"), F.col("rules")).alias("f")).orderBy("i").collect()] == [c[2] for c in cases]


def test_music_rules_beyond_ascii_and_strict_urls(spark):
    from tidemark.operators import classify as C

    def of(text, *links):
        df = spark.createDataFrame([(text, list(links))], "text string, links array<string>")
        return df.select(C.rules(F.col("text"), F.col("links"), C.tags(F.col("text"), F.array().cast("array<string>")))).first()[0]

    assert of("listening\u00a0to this") == ["intent:listening_to"]
    assert of("\u00e9#np hi") == [] and of("(#np hi") == ["hashtag:#np"]
    assert of("on\u2003REPEAT") == ["intent:on_repeat"] and of("\u00e9on repeat") == []
    for link, host in {
        "https://bandcamp.com/a b|c": "bandcamp.com",
        "https://www.youtube.com/watch?v={1}": "youtube.com",
        "https://last.fm/music/100%": "last.fm",
        "//youtu.be/1": "youtu.be",
        " HTTPS://user:pw@x@Artist.BandCamp.com.:8080/y": "bandcamp.com",
        "https://soundcloud.com#x": "soundcloud.com",
        "https:\n//last.fm/1": "last.fm",
    }.items():
        assert of("x", link) == [f"link:{host}"], link
    for link in ("https://NHL.com]", "https://[last.fm/x", "last.fm/music", "https:///last.fm", "mailto:x@last.fm", "https://x.org/?u=//last.fm", ""):
        assert of("x", link) == [], link


def test_posts_are_dealt_to_tasks_and_matched_once(spark, data):
    from tidemark.plans import QUERIES

    for name in ("music_feed", "music_rules"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("new\\s+album") == 1, name
        assert plan.index("new\\s+album") < plan.index("Exchange"), name
