"""Published versions survive a failure at any step; streams with state give the batch's rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import published as P
from tidemark.streaming import ingest as I
from tidemark.streaming import stateful as T

KIND = "k int, x double"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), KIND)


def seen(spark, path, pointer=None):
    rows = P.rows_of(spark, path, pointer)
    return None if rows is None else sorted(map(tuple, rows.collect()))


def test_publish_withdraw_and_pin(spark, tmp_path):
    path = str(tmp_path / "t")
    assert P.current(spark, path) is None and P.rows_of(spark, path) is None
    one = P.publish(frame(spark, (1, 1.0), (2, 2.0)), path, "a", keys=["k"])
    two = P.publish(frame(spark, (2, 5.0), (3, 3.0)), path, "b", keys=["k"], checks={"x": F.col("x") > 0})
    assert (one.number, two.number) == (1, 2) and P.current(spark, path) == two
    assert seen(spark, path) == [(2, 5.0), (3, 3.0)] and seen(spark, path, one) == [(1, 1.0), (2, 2.0)]
    assert [tuple(r) for r in P.rows_of(spark, path, two, kind="withdrawn").collect()] == [(1, "b")]
    assert P.rows_of(spark, path, one, kind="withdrawn").count() == 0
    with pytest.raises(ValueError):
        P.publish(frame(spark, (9, 1.0)), path, "b", keys=["k"])
    assert seen(spark, path) == [(2, 5.0), (3, 3.0)]


def test_broken_versions_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    P.publish(frame(spark, (1, 1.0)), path, "a", keys=["k"])
    with pytest.raises(P.Refused) as e:
        P.publish(frame(spark, (1, -1.0), (1, 2.0), (None, None)), path, "b", keys=["k"], checks={"positive": F.col("x") > 0})
    assert e.value.counts == {"positive": 2, "k is null": 1, "repeated keys": 1}
    assert seen(spark, path) == [(1, 1.0)]
    P.publish(frame(spark, (4, 4.0)), path, "b", keys=["k"])  # tried again under its name
    assert seen(spark, path) == [(4, 4.0)]


def test_unfinished_runs_are_refused(spark, tmp_path):
    units = lambda *x: spark.createDataFrame([(i,) for i in x], "unit int")
    run = P.finished(units(1, 2, 3), units(1, 3, 3, 9), ["unit"])
    assert tuple(run.first()) == (3, 2, 1, False)
    path = str(tmp_path / "t")
    with pytest.raises(P.Unfinished):
        P.publish(frame(spark, (1, 1.0)), path, "a", keys=["k"], run=run)
    assert not (tmp_path / "t").exists()
    assert not P.finished(units(), units(), ["unit"]).first()["marked"]
    P.publish(frame(spark, (1, 1.0)), path, "a", keys=["k"], run=P.finished(units(1, 2), units(2, 1), ["unit"]))
    assert seen(spark, path) == [(1, 1.0)]


@pytest.mark.parametrize("step", ["audit", "withdrawn", "point"])
def test_a_failure_at_any_step_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    P.publish(frame(spark, (1, 1.0)), path, "a", keys=["k"])

    def fail(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(P, step, fail)
        with pytest.raises(OSError):
            P.publish(frame(spark, (2, 2.0)), path, "b", keys=["k"])
    assert seen(spark, path) == [(1, 1.0)] and P.current(spark, path).version == "a"
    P.publish(frame(spark, (2, 2.0)), path, "b", keys=["k"])
    assert seen(spark, path) == [(2, 2.0)]


def test_of_two_publishers_one_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    first = P.publish(frame(spark, (1, 1.0)), path, "a", keys=["k"])
    P.point(spark, path, first, "b", {"all": "a"})
    with pytest.raises(RuntimeError):
        P.point(spark, path, first, "c", {"all": "a"})
    assert P.current(spark, path).version == "b"


def test_latest_rows_after_restarts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    batch = lambda *rows: spark.createDataFrame(list(rows), "k string, at timestamp, x int")
    put = lambda n, *rows: P.upsert_latest(batch(*rows), n, path, keys=["k"], newest="at", buckets=3)
    now = lambda: {r.k: (r.at.hour, r.x) for r in P.rows_of(spark, path).collect()}
    put(0, ("a", at(1), 1), ("a", at(3), 2), ("b", at(1), 1), ("c", at(9), 9))
    assert now() == {"a": (3, 2), "b": (1, 1), "c": (9, 9)}
    pinned = P.current(spark, path)
    with monkeypatch.context() as m:  # all is written, the pointer is not
        m.setattr(P, "point", lambda *_, **__: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            put(1, ("a", at(2), 7), ("b", at(2), 8), ("d", at(1), 1))
    assert now() == {"a": (3, 2), "b": (1, 1), "c": (9, 9)}
    for _ in range(2):
        put(1, ("a", at(2), 7), ("b", at(2), 8), ("d", at(1), 1))
    put(0, ("b", at(5), 0))  # an old batch comes again
    assert now() == {"a": (3, 2), "b": (2, 8), "c": (9, 9), "d": (1, 1)}
    put(2, ("c", at(9), 10))  # a tie: the larger row
    assert now()["c"] == (9, 10)
    assert {r.k for r in P.rows_of(spark, path, pinned).collect()} == {"a", "b", "c"}
    assert put(3) == P.current(spark, path)


def stream_of(spark, tmp_path, rows, kind):
    """Rows as a stream, one file a batch in the given order."""
    import time

    for i, part in enumerate(rows):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
        time.sleep(0.02)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def day(d, h=0):
    return datetime.datetime(2024, 1, d, h)  # the first is a Monday


def test_weekly_readings_out_of_order(spark, tmp_path):
    kind = "key string, at timestamp, plays long, listeners long"
    rows = [
        [("a", day(2), 10, 1), ("b", day(3), 5, None), ("a", day(6), 20, 2), ("c", day(1), 1, 1)],
        [("a", day(4), 15, 2), ("a", day(6), 20, 2), ("b", day(9), 7, 7), ("a", day(9), 30, 1)],  # late, again
        [("a", day(7), 21, 2), ("c", day(17), 9, 9), ("b", day(16), 8, 8)],  # later in the first week than what was known
        [("a", day(5), 99, 99), ("z", day(31), 1, 1)],  # too late: its week is closed
    ]
    stream = stream_of(spark, tmp_path, rows, kind)
    I.write(T.with_status(T.weekly_readings(stream, "2 days")), str(tmp_path / "state"), I.append_once(str(tmp_path / "out"))).awaitTermination()
    found = {(r.key, r.week.day): (r.plays, r.last_plays, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {
        ("a", 1): (21, None, "first_observation"),
        ("b", 1): (5, None, "first_observation"),
        ("c", 1): (1, None, "first_observation"),
        ("a", 8): (30, 21, "counter_decrease"),
        ("b", 8): (7, 5, "incomplete_pair"),
        ("b", 15): (8, 7, "valid_weekly"),
        ("c", 15): (9, 1, "nonconsecutive_weeks"),
    }
    whole = spark.createDataFrame([r for part in rows[:3] for r in part], kind)
    assert {(r.key, r.week.day): (r.plays, r.last_plays, r.status) for r in T.with_status(T.weekly_pairs(whole)).collect()} == found


def test_unread_polls(spark, tmp_path):
    kind = "kind string, uri string, target int, at timestamp"
    post = lambda u, at: ("post", u, 0, at)
    read = lambda u, t, at: ("reading", u, t, at)
    rows = [
        [post("a", day(1)), post("b", day(1)), post("c", day(1)), post("a", day(1))],
        [read("a", 24, day(1, 20)), read("b", 24, day(2, 3)), read("b", 72, day(3, 12)), read("c", 72, day(2))],
        [read("a", 24, day(1, 20)), post("d", day(8)), read("c", 24, day(2)), read("x", 24, day(8))],  # read at the last moment
        [post("e", day(20)), read("e", 24, day(20, 9)), read("y", 24, day(20))],
    ]
    stream = stream_of(spark, tmp_path, rows, kind)
    posts, readings = (lambda s: (s.where("kind = 'post'").select("uri", F.col("at").alias("created_at")), s.where("kind = 'reading'").select("uri", "target", "at")))(stream)
    I.write(T.unread(posts, readings, delay="2 days"), str(tmp_path / "state"), I.append_once(str(tmp_path / "out"))).awaitTermination()
    found = {(r.uri, r.target): r.due_at for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {("a", 72): day(4), ("b", 24): day(2), ("d", 24): day(9), ("d", 72): day(11)}
    whole = spark.createDataFrame([r for part in rows for r in part], kind)
    batch = T.unread_by(whole.where("kind = 'post'").select("uri", F.col("at").alias("created_at")), whole.where("kind = 'reading'").select("uri", "target", "at"), F.lit(day(18)))
    assert {(r.uri, r.target): r.due_at for r in batch.collect()} == found


def test_unread_polls_keep_a_row_for_each_bucket_and_equal_the_batch_form(spark, tmp_path):
    kind = "kind string, uri long, target int, at timestamp"
    micro, hour = datetime.timedelta(microseconds=1), datetime.timedelta(hours=1)
    rows = []
    for n in range(400):
        at = day(1) + n * datetime.timedelta(minutes=72)  # 20 days
        rows.append(("post", n, 0, at))
        if n % 11 == 0:
            rows.append(("post", n, 0, at + hour))  # repeated later: the earliest counts
        for target in (24, 72):
            # before the post, with it, at the last moment, after it, not at all, twice, or both before and after
            met = [[-micro], [0 * hour], [target * hour], [target * hour + micro], [], [hour, hour], [-micro, target * hour + micro]][n * target // 24 % 7]
            rows.extend(("reading", n, target, at + x) for x in met)
    rows += [("reading", 1, 48, day(2)), ("reading", 5000, 24, day(3)), ("reading", None, 24, day(2)), ("post", None, 0, day(2)), ("post", None, 0, day(2)), ("post", 6000, 0, None)]
    rows += [("post", 7000, 0, day(25)), ("reading", 7000, 24, day(25, 5))]
    batches = [[r for r in rows if (r[3] or day(1)) < day(8)], [r for r in rows if r[3] and day(8) <= r[3] < day(15)], [r for r in rows if r[3] and r[3] >= day(15)]]
    # readings come a batch before their posts, posts a day late
    moved = [r for r in batches[1] if r[0] == "reading" and r[3] < day(9)]
    late = [r for r in batches[0] if r[0] == "post" and r[3] and r[3] >= day(7)]
    batches = [[r for r in batches[0] if r not in late] + moved, [r for r in batches[1] if r not in moved] + late, batches[2]]
    posts, readings = (lambda s: (s.where("kind = 'post'").select("uri", F.col("at").alias("created_at")), s.where("kind = 'reading'").select("uri", "target", "at")))(stream_of(spark, tmp_path, batches, kind))
    query = I.write(T.unread(posts, readings, delay="4 days"), str(tmp_path / "state"), I.append_once(str(tmp_path / "out")))
    query.awaitTermination()
    found = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select("uri", "target", "due_at").collect()))
    whole = spark.createDataFrame([r for part in batches for r in part], kind)
    batch = T.unread_by(whole.where("kind = 'post'").select("uri", F.col("at").alias("created_at")), whole.where("kind = 'reading'").select("uri", "target", "at"), F.lit(day(21)))
    assert len(found) > 300 and found == sorted(map(str, batch.select("uri", "target", "due_at").collect()))
    # hundreds of posts and their readings wait: joins kept several rows for each
    assert max(sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress) <= 513


def test_weeks_that_close_together_cost_one_state_call_each_way():
    class Value:
        calls, value = [], (5, 1, None)

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    pairs = T.WeeklyPairs()
    pairs.init(Handle())
    rows = [{"week": day(d).date(), "at_us": d, "plays": d, "listeners": None} for d in (15, 8, 29)]
    found = [(r["week"].day, r["last_at_us"], r["last_plays"]) for r in pairs.handleInputRows(("a",), iter(rows), None)]
    assert found == [(8, 5, 1), (15, 8, 8), (29, 15, 15)] and Value.calls == ["get", "update"] and pairs.last.value == (29, 29, None)


def test_arriving_parts_read_the_rows_a_fixed_number_of_times(spark):
    from tidemark.plans import stream_queries as Q

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i, day(1 + i % 30)) for i in range(300)], "n long, at timestamp")
    stream, folder = Q.arriving(spark, rows.mapInArrow(counted, rows.schema), "at", "n")
    # the first time, the rows, and those that come again; not once more for each of the four or five parts
    assert read.value == 900 and set(stream.columns) == {"n", "at"}
    whole = spark.read.option("recursiveFileLookup", "true").schema(rows.schema).parquet(f"{folder}/in")
    assert whole.distinct().exceptAll(rows).count() == 0 and whole.select("n").distinct().count() == 300
