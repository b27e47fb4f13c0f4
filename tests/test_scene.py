"""The scene map on planted clusters."""

import numpy as np
import pytest

from tidemark.operators import scene as M
from tidemark.operators.resolve import scene


def clusters(spark, n=120, groups=8, width=24, noise=0.25):
    r = np.random.default_rng(3)
    centres = r.normal(size=(groups, width))
    rows = [(f"c{i:03d}", [float(x) for x in centres[i % groups] + r.normal(0, noise, width)]) for i in range(n)]
    return spark.createDataFrame(rows, "genre string, centroid array<double>"), rows


@pytest.mark.parametrize("block", [512, 17])
def test_neighbours(spark, block):
    df, rows = clusters(spark, 60)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    far = 1 - x @ x.T
    np.fill_diagonal(far, np.inf)
    found = {}
    for r in M.neighbours(df, "genre", "centroid", 4, block=block).collect():
        found.setdefault(r.genre, []).append((r["rank"], r.other, r.distance))
    for i, (name, _) in enumerate(rows):
        own = sorted(found[name])
        assert [o for _, o, _ in own] == [rows[j][0] for j in np.argsort(far[i])[:4]]
        assert [d for *_, d in own] == pytest.approx(np.sort(far[i])[:4])


def test_neighbours_of_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (None, [1.0, 0.0]), (6, []), (7, [1.0, 1.0])], "genre int, centroid array<double>")
    found = {(r.genre, r.other) for r in M.neighbours(df, "genre", "centroid", 5).collect()}
    assert found == {(a, b) for a in (1, 2, 7) for b in (1, 2, 7) if a != b}


def test_fuzzy_edges(spark):
    df, _ = clusters(spark, 60)
    k = 8
    near = M.neighbours(df, "genre", "centroid", k)
    one = {}
    for r in near.collect():
        one.setdefault(r.genre, {})[r.other] = r.distance
    edges = {(r.genre, r.other): r.weight for r in M.fuzzy_edges(near, "genre", k).collect()}
    assert set(edges) == {p for a, d in one.items() for b in d for p in ((a, b), (b, a))}
    assert all(edges[a, b] == pytest.approx(edges[b, a]) and 0 <= w <= 1 for (a, b), w in edges.items())
    for a, d in one.items():
        nearest = min(d, key=d.get)
        assert edges[a, nearest] == pytest.approx(1.0)


def test_clusters_stay_together(spark):
    df, rows = clusters(spark, 120, 20, 24, 0.3)
    near = M.neighbours(df, "genre", "centroid", 5)
    flat = M.kept_neighbours(scene(df), near, "genre", 5)
    places = M.scene_map(df)
    own = M.kept_neighbours(places, near, "genre", 5)
    at = {r.genre: np.array([r.x, r.y]) for r in places.collect()}
    assert len(at) == 120 and all(np.isfinite(v).all() for v in at.values())
    assert own > flat + 0.2, (own, flat)
    # of a category's nearest 5 places, most are of its cluster
    names = [n for n, _ in rows]
    xy = np.array([at[n] for n in names])
    far = np.linalg.norm(xy[:, None] - xy, axis=2)
    np.fill_diagonal(far, np.inf)
    same = np.mean([j % 20 == i % 20 for i in range(120) for j in np.argsort(far[i])[:5]])
    assert same > 0.8
    again = [sorted((r.genre, round(r.x, 6), round(r.y, 6)) for r in M.scene_map(d, steps=2).collect()) for d in (df, df.repartition(3))]
    assert again[0] == again[1]


def test_few_categories(spark):
    df, _ = clusters(spark, 2)
    assert M.scene_map(df).count() == 0
    four, _ = clusters(spark, 4)
    assert M.scene_map(four, steps=3).count() == 4
    with pytest.raises(ValueError):
        M.scene_map(four.unionByName(spark.createDataFrame([("z", [1.0])], four.schema)))


def test_neighbours_meet_once(spark):
    # a vector is sent once to each other block, not once for asking and once for being asked; ties go to the smaller key
    df = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(40)], "genre int, centroid array<double>")
    for block in (7, 512):
        near = M.neighbours(df, "genre", "centroid", 3, block=block).collect()
        found = {}
        for r in near:
            found.setdefault(r.genre, []).append((r["rank"], r.other))
        assert all([o for _, o in sorted(x)] == [j for j in range(40) if j != i and j % 3 == i % 3][:3] for i, x in found.items()) and len(found) == 40
    assert M.BLOCK >= 4096
