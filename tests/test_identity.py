"""Hash trees, names in texts, sets, aliases and vectors of texts on worked examples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import texts as T
from tidemark.operators import aliases as A
from tidemark.operators import embed as M
from tidemark.operators import evaluate as E
from tidemark.operators import versions as V


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k long, x string, y double")


def tree(df, levels=None, width=4):
    return V.range_tree(df, F.floor(F.col("k") / width), ["k", "x", "y"], fanout=4, levels=levels)


def test_trees_do_not_depend_on_partitions_or_order(spark):
    rows = [(i % 150, f"v{i}" if i % 7 else None, i / 3 if i % 5 else None) for i in range(400)] + [(3, "same", 1.0)] * 50
    random.Random(1).shuffle(rows)
    one = {tuple(r) for r in tree(keyed(spark, rows)).collect()}
    assert {tuple(r) for r in tree(keyed(spark, rows[::-1]).repartition(7)).collect()} == one
    tops = [r for r in one if r[0] == max(x[0] for x in one)]
    assert len(tops) == 1 and tops[0][1:3] == (0, 450)
    # a row once more, another value, and NULL in place of a text change the root
    for other in (rows + [rows[0]], [(*rows[0][:2], -1.0), *rows[1:]], [(rows[0][0], "v\\N", rows[0][2]), *rows[1:]]):
        assert not {r[3] for r in tops} & {r.digest for r in tree(keyed(spark, other)).collect() if r.level == tops[0][0]}


def test_differing_ranges(spark):
    rows = [(i, f"v{i}", 1.0) for i in range(200)]
    new = [r for r in rows if not 40 <= r[0] < 48] + [(i, "new", 0.0) for i in range(200, 290)]
    new[5] = (5, "other", 1.0)
    found = {r.node: r.change for r in V.differing_ranges(tree(keyed(spark, new)), tree(keyed(spark, rows)), fanout=4).collect()}
    assert found == {1: "changed", 10: "removed", 11: "removed"} | dict.fromkeys(range(50, 73), "added")
    assert V.differing_ranges(tree(keyed(spark, rows)), tree(keyed(spark, rows[::-1])), fanout=4).count() == 0
    empty = keyed(spark, [])
    assert {r.change for r in V.differing_ranges(tree(keyed(spark, rows)), tree(empty), fanout=4).collect()} == {"added"}


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Listening to Mitski and the Sad Ones today", ["Mitski and the Sad Ones"]),
        ('the "Quiet Hours" tape, “Nachtzug,” and "Quiet Hours"', ["Quiet Hours", "Nachtzug"]),
        ("don't say it's 'Low' or 'x'", ["Low"]),
        ("a NEW Boards of Canada album", ["Boards of Canada"]),
        ("Orbital just dropped; listening  to Low", ["Orbital", "Low"]),
        ("listening to nothing", []),
        ('"a" "b c" ""', ["b c"]),
        ("new Sigur Rós album", ["Sigur Rós"]),
        ("line\n'one\ntwo' just dropped", []),
        ("", []),
        (None, []),
    ],
)
def test_candidate_names(text, names):
    assert list(dict.fromkeys(n for _, _, n in T.spans_of(text))) == names


def test_spans_have_places(spark):
    df = spark.createDataFrame([("so listening to Low, 'Hey What'",), (None,)], "t string").select(T.name_spans("t").alias("s"))
    assert [[tuple(x) for x in r.s] for r in df.collect()] == [[(3, "listening", "Low"), (21, "single", "Hey What")], []]


def test_sets_are_counted_by_item(spark):
    items = spark.createDataFrame([(1, "a", "m1", "m1"), (2, "a", "m2", "m9"), (3, "b", None, None), (4, "b", None, "m4"), (5, None, "x", None)], "id int, k string, p_id string, a_id string")
    predicted = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x"), (3, "unclassified"), (4, "z"), (5, None)], "id int, label string")
    actual = spark.createDataFrame([(1, "x"), (1, "w"), (2, "x"), (3, "unclassified"), (5, "q"), (9, "x")], "id int, label string")
    plain = {r.id: (r.tp, r.fp, r.fn, r.right) for r in E.counted_sets(items, predicted, actual, "id", "label").collect()}
    assert plain == {1: (1, 1, 1, False), 2: (1, 0, 0, True), 3: (0, 0, 0, True), 4: (0, 1, 0, False), 5: (0, 0, 1, False)}
    own = E.counted_sets(items, predicted, actual, "id", "label", exact=("p_id", "a_id"))
    gated = {r.id: (r.tp, r.fp, r.fn, r.right) for r in own.collect()}
    assert gated[2] == (0, 1, 1, False) and gated[4] == (0, 1, 0, False) and gated[1] == plain[1] and gated[3] == plain[3]
    rolled = {(r.depth, r.k): (r["items"], r.exact, r.tp, r.precision, r.recall) for r in E.rolled_up(own, ["k"]).collect()}
    assert rolled[1, "b"] == (2, 1, 0, 0.0, None) and rolled[1, None] == (1, 0, 0, None, 0.0)
    assert rolled[0, None] == (5, 1, 1, 1 / 4, 1 / 4) and rolled[1, "a"][:3] == (2, 0, 1)


def test_aliases(spark):
    rows = [(1, 10, "Garage"), (2, 10, "garage "), (3, 20, "GARAGE"), (4, 20, "Drum and Bass"), (4, 20, "drum and bass"), (5, 20, "D"), (6, 30, None), (6, 30, " ")]
    table = A.owned(spark.createDataFrame(rows, "genre int, family int, alias string"))
    assert {(r.folded, r.genre, r.owners, r.family_owners) for r in table.collect()} == {("garage", 1, 3, 2), ("garage", 2, 3, 2), ("garage", 3, 3, 1), ("drum and bass", 4, 1, 1), ("d", 5, 1, 1)}
    names = spark.createDataFrame([("Garage", None), ("Garage", 10), ("Garage", 20), ("DRUM and bass", 10), ("x", 10), (None, 10)], "name string, family int")
    assert {(r.name, r.family): (r.genre, r.method) for r in A.resolved(names, table).collect()} == {
        ("Garage", None): (None, "ambiguous"), ("Garage", 10): (None, "ambiguous"), ("Garage", 20): (3, "family"), ("DRUM and bass", 10): (4, "alias"), ("x", 10): (None, "unknown"), (None, 10): (None, "unknown"),
    }


def test_search_equals_a_scan(spark):
    r = random.Random(2)
    names = ["".join(r.choice("ab c") for _ in range(r.randint(1, 9))) for _ in range(150)]
    table = A.owned(spark.createDataFrame([(i % 40, 0, n) for i, n in enumerate(names)], "genre int, family int, alias string"))
    queries = ["a", "B", "ab", "abc", "a b", "c a", "zz", "abz", "", " ab ", "aaaaaaaaaaaa", "b ca"]
    found = {}
    for x in A.searched(spark.createDataFrame([(q,) for q in queries], "query string"), table, most=7).collect():
        found.setdefault(x["query"], []).append((x.place, x.folded, x.genre))
    rows = {(x.folded, x.genre) for x in table.collect()}
    for q in queries:
        p = q.lower().strip()
        want = sorted(((0 if f == p else 1 if f.startswith(p) else 2, len(f), f, g) for f, g in rows if p and p in f))[:7]
        assert [x[1:] for x in sorted(found.get(q, []))] == [(f, g) for _, _, f, g in want], q


def lengths(scale):
    """A model that counts how often it was loaded in its process."""
    lengths.loaded = getattr(lengths, "loaded", 0) + 1
    n = lengths.loaded
    return lambda texts: np.array([[scale * len(t), len(texts), n] for t in texts], float)


def test_any_model_embeds(spark):
    df = spark.createDataFrame([(i, "x" * i if i % 5 else None, "e") for i in range(60)], "i int, t string, embedding string").repartition(3)
    out = M.embedded(df, "t", load=lengths, arguments=(2,), batch=8).collect()
    assert len(out) == 60 and list(out[0].asDict()) == ["i", "t", "embedding"]
    for r in out:
        assert (r.embedding is None) == (r.t is None)
        if r.t is not None:
            assert r.embedding[0] == 2 * r.i and r.embedding[1] <= 8 and r.embedding[2] == 1  # loaded once in a worker
    zero, one, same = (np.array(r.embedding) for r in M.embedded(spark.createDataFrame([(0, ""), (1, "a b a"), (2, "b a  a")], "i int, t string"), "t", arguments=(8,)).orderBy("i").collect())
    assert not zero.any() and np.linalg.norm(one) == pytest.approx(1) and (one == same).all()


def test_differing_ranges_hash_each_table_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(k, k % 7, None) for k in range(1000)]
    df = spark.createDataFrame(rows, "k long, x long, y string")
    of = lambda d: V.range_tree(d.mapInArrow(counted, d.schema), F.floor(F.col("k") / 4), ["k", "x", "y"], fanout=4, levels=3)
    found = V.differing_ranges(of(df), of(df.where("k <> 9")), fanout=4).collect()
    assert [(r.node, r.change) for r in found] == [(2, "changed")] and read.value == 1999
