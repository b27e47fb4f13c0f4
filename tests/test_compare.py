"""Ledgers, gates, the entity ladder and the demo table on worked rows."""

import datetime
import random

from pyspark.sql import functions as F

from tidemark.functions.texts import token_set_score
from tidemark.operators import compare as C
from tidemark.operators import demo as D
from tidemark.operators import entities as N
from tidemark.operators import resolve as E
from tidemark.plans import QUERIES


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ledger_states(spark):
    one = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 4.0), (6, None)], "k int, x double")
    two = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, 3.0), (5, 5.0), (6, None)], "k int, x double")
    assert [r.change for r in C.ledger(one, two, ["k"], "x").orderBy("k").collect()] == ["same", "changed", "filled", "removed", "added", "same"]
    assert C.ledger(two, one, ["k"], "x").where("k = 3").first().change == "withheld"
    assert C.ledger(one.where("false"), two.where("false"), ["k"], "x").count() == 0


def test_rank_ledger_breaks_ties_by_key(spark):
    one = spark.createDataFrame([(0, "a", 2.0), (0, "b", 2.0), (0, "c", 1.0), (0, "d", None)], "w int, k string, x double")
    two = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (0, "c", 3.0)], "w int, k string, x double")
    assert values(C.rank_ledger(one, two, ["w"], "k", "x", 1)) == [(0, "a", 1, 3, -2, "leaves"), (0, "b", 2, 2, 0, None), (0, "c", 3, 1, 2, "enters")]


def test_missing_and_forecast_ledgers(spark):
    cells = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int").withColumn("f", F.lit("f"))
    one, two = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, None)], "k int, x double"), spark.createDataFrame([(1, 1.0), (3, 1.0)], "k int, x double")
    assert values(C.missing_ledger(cells, one, two, ["k"], "x", ["f"])) == [("f", 1, 1, 1, 1)]
    f = lambda *rows: spark.createDataFrame(rows, "k int, predicted double, actual double")
    out = C.forecast_ledger(f((1, 1.0, 2.0), (2, 1.0, 1.0), (3, 1.0, 4.0)), f((1, 4.0, 2.0), (2, 1.0, 1.0), (4, 0.0, 0.0)), ["k"])
    assert [(r.k, r.better) for r in out.orderBy("k").collect()] == [(1, "one"), (2, "tie"), (3, "unpaired"), (4, "unpaired")]


def test_gates_fail_closed(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "g string, x double")
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "g string")
    gated = C.gates(df, expected, "g", {"small": F.max("x") < 5, "some": F.count(F.lit(1)) > 0})
    assert values(gated) == [("a", True, True, True), ("b", False, True, False), ("c", False, False, False)]
    assert not C.release(gated, {}).first().released and C.release(gated.where("g = 'a'"), {"any": F.count(F.lit(1)) > 0}).first().released
    assert tuple(C.release(gated.where("false"), {}).first()) == (False, False)


def test_entity_ladder(spark):
    aliases = spark.createDataFrame([("e1", "The Night Owls"), ("e1", "Night Owls"), ("e2", "Blue Rivers"), ("e3", "blue rivers"), ("e4", "Radiohead"), (None, "x"), ("e9", None)], "entity string, alias string")
    posts = spark.createDataFrame([(1, "e7"), (2, None), (3, None), (4, None), (5, None), (6, None), (7, None)], "post_id int, direct string")
    names = spark.createDataFrame([(1, "Night Owls"), (2, "night   owls!"), (2, "Nobody"), (3, "Blue Rivers"), (4, "Unheard Of"), (6, "Radiohed"), (7, None), (7, "")], "post_id int, name string")
    out = {r.post_id: (r.entity, r.method, r.outcome) for r in N.resolved_posts(posts, names, aliases).collect()}
    assert out == {1: ("e7", "link", "resolved"), 2: ("e1", "name", "resolved"), 3: (None, None, "ambiguous"), 4: (None, None, "no_match"), 5: (None, None, "no_candidate"), 6: ("e4", "name", "resolved"), 7: (None, None, "no_match")}
    assert N.resolved_posts(posts.where("false"), names, aliases).count() == 0 and N.matched_names(names, aliases.where("false")).where("outcome <> 'no_match'").count() == 0


def test_no_name_above_the_floor_is_missed(spark, data):
    r = random.Random(4)
    words = ["the", "of", "a", "metallicas", "nightowls", "rivers", "été", "x", "radiohead", "abcabcabcabc"]
    made = [" ".join(r.choices(words, k=r.randint(1, 5))) for _ in range(60)]
    edited = lambda t: "".join(r.choice(["", c + r.choice("aez "), r.choice("aez")]) if r.random() < 0.07 else c for c in t)
    left, right = ["netallicas", "the", "", *map(edited, made)], [*made, *map(edited, made)]
    names = spark.createDataFrame([(x,) for x in left], "name string")
    aliases = spark.createDataFrame(list(enumerate(right)), "entity int, alias string")
    for least in (70.0, 87.0, 90.0):
        want = {(x, i) for x in left for i, y in enumerate(right) if token_set_score(x, y) >= least}
        assert {(n.name, n.entity) for n in N.scored_names(names, aliases, least=least).collect()} == want
    found = {x.c_custkey: (x.s_suppkey, x.score) for x in QUERIES["token_set_match"](spark, data).collect()}
    suppliers = [(x.s_suppkey, "customer " + x.s_name[-9:]) for x in spark.read.parquet(f"{data}/supplier.parquet").collect()]
    customers = spark.read.parquet(f"{data}/customer.parquet").collect()
    assert len(found) == len(customers)
    for c in customers:
        score, key = min((-token_set_score(c.c_name, alias), key) for key, alias in suppliers)
        assert found[c.c_custkey] == ((key, round(-score, 6)) if -score >= 90 else (None, None))


def test_numbered_names_meet_few_others(spark):
    # names that differ by their numbers share most pairs of characters; only those that a digit parts are compared
    numbers = [f"customer {i:09d}" for i in range(400)]
    left = N._prepared(spark.createDataFrame([(x,) for x in numbers], "name string"), "name")
    right = N._prepared(spark.createDataFrame([(x,) for x in numbers], "alias string"), "alias")
    found = {tuple(r) for r in N._candidates(left, right, 90.0).collect()}
    want = {(x, y) for x in numbers for y in numbers if token_set_score(x, y) >= 90}
    assert want <= found and len(found) <= 1.05 * len(want), (len(found), len(want))


def test_keys_of_names_do_not_pass_through_the_driver(spark):
    # a name has some twenty keys, and Spark takes all of them together for as few bytes as the names
    numbers = spark.range(400).selectExpr("format_string('customer %09d', id) as name")
    left, right = N._prepared(numbers, "name"), N._prepared(numbers.withColumnRenamed("name", "alias"), "alias")
    assert "Broadcast" not in N._candidates(left, right, 90.0)._jdf.queryExecution().executedPlan().toString()


def test_best_names_are_the_first_of_all_scores(spark):
    r = random.Random(6)
    words = ["the", "night", "owls", "rivers", "00012", "00021", "radiohead", "été"]
    made = [" ".join(r.choices(words, k=r.randint(1, 4))) for _ in range(50)]
    edited = ["".join(c for c in t if r.random() > 0.05) + r.choice(["", "", " x", "s"]) for t in made]
    names = spark.createDataFrame([(x,) for x in [*made, *edited, "", None]], "name string")
    # several entities share an alias, some have several, some none
    aliases = spark.createDataFrame([(i % 40, x) for i, x in enumerate([*made, *edited, *edited])] + [(None, made[0]), (3, None)], "entity int, alias string")
    for least in (75.0, 90.0):
        every = {}
        for n in N.scored_names(names, aliases, least=least).collect():
            every[n.name] = min(every.get(n.name, (0.0, 0)), (-n.score, n.entity))
        assert every and {n.name: (-n.score, n.entity) for n in N.best_names(names, aliases, least=least).collect()} == every
    assert N.best_names(names.where("false"), aliases, least=90.0).count() == 0 == N.best_names(names, aliases.where("false"), least=90.0).count()


def test_direct_links(spark):
    urls = ["https://a.example.org/artist/ab-1?x", "https://example.org/other", "https://bexample.org/artist/c", "https://example.org/artist/a%20b", "::bad", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(N.linked_path(F.col("u"), ["example.org"], "^/artist/([^/]+)")).collect()] == ["ab-1", None, None, "a b", None, None]


def test_pending_and_activation(spark):
    at = datetime.datetime
    posts = spark.createDataFrame([(i,) for i in range(1, 6)], "post_id int")
    tried = spark.createDataFrame([(2, at(2024, 1, 1), True, "mbid"), (3, at(2024, 1, 1), True, "name"), (4, at(2024, 1, 1), False, None), (5, at(2024, 3, 1), False, None)], "post_id int, tried_at timestamp, resolved boolean, kind string")
    upstream = spark.createDataFrame([(at(2024, 2, 1),)], "newest timestamp")
    assert values(N.pending(posts, tried, upstream)) == [(1,), (3,), (4,)]
    assert values(N.pending(posts, tried, upstream.where("false"))) == [(1,)]
    rows = spark.createDataFrame([("a", True, True)] * 20 + [("b", True, True)] * 19 + [("c", False, False)] * 30, "g string, p boolean, a boolean")
    assert {r.g: r.active for r in N.activation(E.agreement(rows, ["g"], "p", "a")).collect()} == {"a": True, "b": False, "c": False}


def test_demo_faults(spark):
    cells = lambda first, weeks, genres: spark.createDataFrame([(first + datetime.timedelta(days=7 * i), g) for i in range(weeks) for g in range(genres)], "week date, genre int")
    df = D.weekly(cells(datetime.date(2024, 1, 1), 4, 3))
    names = ["conv", "listen", "releases"]
    assert tuple(D.faults(df, 12, names).first()) == (0, 0, 0, 0)
    assert tuple(D.faults(df.unionAll(df.limit(1)).withColumn("conv", F.lit(None).cast("double")), 12, names).first()) == (1, 1, 13, 0)
    assert D.faults(D.weekly(cells(datetime.date(2024, 1, 2), 2, 1)), 2, names).first().not_mondays == 2
