"""The scene map: categories in two dimensions, so that neighbours in embedding space stay neighbours.

A graph of nearest neighbours by cosine gets fuzzy weights (the nearest neighbour counts fully, the others less by an
own scale for each category, so that every category has the same total), both directions united. Places begin at the
principal components, and are then moved step by step: edges pull, and a few others, drawn by hash anew in each step,
push. Every step is two joins of edges and places and one aggregation; what is drawn depends on names alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.resolve import scene
from tidemark.sources.tables import remove, settled

#: Neighbours of a category at most; categories that a task compares with as many others, and how many of them at once.
NEIGHBOURS, BLOCK, STRIP = 15, 8192, 512
#: The curve 1 / (1 + a d^(2 b)) that stands for a least distance of 0.1.
CURVE = 1.577, 0.895
LEAST = 3


def neighbours(df: DataFrame, key: str, vector: str, k: int, *, block: int = BLOCK) -> DataFrame:
    """(key, other, distance, rank): the k others of least cosine distance (ties to the smaller key). NULL, empty, zero and
    non-finite vectors have no neighbours. Categories are dealt into blocks; every task compares two blocks in strips and keeps k for each
    row of both. The work is quadratic in the categories, what is sent grows with them times the number of blocks."""
    own = df.select(F.col(key).alias("a"), F.col(vector).alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    own = own.where(F.col("a").isNotNull() & fine)
    blocks = max(1, -(-own.count() // block))
    own = own.withColumn("b", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int"))
    # a pair of blocks meets once, and both sides keep what they find
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    cells = own.select("*", F.explode(F.transform(every, lambda j: F.struct(F.least("b", j).alias("i"), F.greatest("b", j).alias("j")))).alias("c")).select("a", "v", "b", "c.*")

    def unit(vectors: pd.Series, width: int) -> np.ndarray:
        lengths = vectors.map(len).to_numpy()
        m = np.zeros((len(vectors), width))
        m[np.arange(width) < lengths[:, None]] = np.concatenate([*vectors]) if len(vectors) else 0
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def nearest(asking: pd.DataFrame, asked: pd.DataFrame) -> list[pd.DataFrame]:
        # the k best of every strip of the other block are kept; what is farther than the k-th is not sorted
        names, others, found = asking.a.to_numpy(), asked.a.to_numpy(), []
        x, y = np.stack(asking.v), np.stack(asked.v)
        for lo in range(0, len(asking), STRIP):
            far = x[lo : lo + STRIP] @ y.T
            np.subtract(1, far, out=far), np.maximum(far, 0.0, out=far)
            if asking is asked:  # a key lies in one block
                far[names[lo : lo + STRIP, None] == others[None, :]] = np.inf
            if len(others) > k:
                # nothing farther than the k-th of a part of the others is among the k; ties go to the smaller key
                few = far[:, : max(k, len(others) // 8)]
                row, col = np.nonzero(far <= np.partition(few, k - 1, axis=1)[:, k - 1 : k])
            else:
                row, col = np.divmod(np.arange(far.size), max(len(others), 1))
            part = pd.DataFrame({"a": names[lo : lo + STRIP][row], "other": others[col], "distance": far[row, col], "row": row})
            part = part[np.isfinite(part.distance)].sort_values(["row", "distance", "other"])
            found.append(part[part.groupby("row").cumcount() < k].drop(columns="row"))
        return found

    def near(part: pd.DataFrame) -> pd.DataFrame:
        part = part[["a", "b", "i", "j"]].assign(v=list(unit(part.v, max(part.v.map(len)))))
        one, two = part[part.b == part.i], part[part.b == part.j]
        if part.i.iloc[0] == part.j.iloc[0]:
            found = nearest(one, one)
        else:
            found = nearest(one, two) + nearest(two, one) if len(one) and len(two) else []
        return pd.concat([pd.DataFrame({"a": part.a[:0], "other": part.a[:0], "distance": np.zeros(0)}), *found])

    kind = own.schema["a"].dataType.simpleString()
    found = cells.groupBy("i", "j").applyInPandas(near, f"a {kind}, other {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("a").orderBy("distance", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("a").alias(key), "other", "distance", "rank")


def fuzzy_edges(near: DataFrame, key: str, k: int) -> DataFrame:
    """(key, other, weight), each pair in both directions: exp(-(distance - nearest) / scale), the scale such that a
    category's weights add up to log2(k); of two directions p and q the weight is p + q - p q."""

    def weighted(part: pd.DataFrame) -> pd.DataFrame:
        # a category's neighbours, k at most
        d = part.distance.to_numpy()
        rest = np.maximum(d - d.min(), 0.0)
        goal, lo, hi, scale = math.log2(max(k, 2)), 0.0, math.inf, 1.0
        for _ in range(64):
            total = float(np.exp(-rest / scale).sum())
            if abs(total - goal) < 1e-5:
                break
            lo, hi = (lo, scale) if total > goal else (scale, hi)
            scale = (lo + hi) / 2 if math.isfinite(hi) else scale * 2
        return pd.DataFrame({"a": part[key], "b": part.other, "w": np.exp(-rest / max(scale, 1e-3 * max(float(d.mean()), 1e-12)))})

    kind = near.schema[key].dataType.simpleString()
    one = near.groupBy(key).applyInPandas(weighted, f"a {kind}, b {kind}, w double")
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count(F.lit(1)).alias("n"))
    return both.select(F.col("a").alias(key), F.col("b").alias("other"), F.when(F.col("n") == 2, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("weight"))


def laid_out(places: DataFrame, edges: DataFrame, key: str, *, steps: int = 25, others: int = 5, push_share: float = 0.3, rate: float = 0.5) -> DataFrame:
    """(key, x, y): places moved by `steps` steps of falling length along the edges' pulls and the pushes of `others` drawn
    places for each edge, which count push_share each."""
    a, b = CURVE
    # categories are a dimension: one short window numbers them
    numbered, _ = settled(places.withColumn("number", F.row_number().over(Window.orderBy(key)) - 1), "places")
    n = numbered.count()
    own, _ = settled(edges.join(numbered.select(key, "number"), key).join(numbered.select(F.col(key).alias("other"), F.col("number").alias("other_number")), "other").select("number", "other_number", "weight"), "edges")
    now, before = numbered.select("number", "x", "y"), None
    # the pull and push of a pair, as factors of the vector between its places
    square = F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2)
    pull = F.when(square > 0, -2 * a * b * F.pow(square, b - 1) / (1 + a * F.pow(square, b))).otherwise(0.0)
    push = push_share * 2 * b / ((0.001 + square) * (1 + a * F.pow(square, b)))
    limited = lambda f, c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), f * (F.col(c) - F.col(f"o{c}"))))
    for step in range(steps):
        drawn = own.select("number", "weight", F.explode(F.transform(F.sequence(F.lit(0), F.lit(others - 1)), lambda j: F.pmod(F.xxhash64("number", "other_number", F.lit(step), j), F.lit(n)).cast("int"))).alias("other_number"))
        pairs = own.withColumn("pulls", F.lit(True)).unionByName(drawn.where("number <> other_number").withColumn("pulls", F.lit(False)))
        pairs = pairs.join(now, "number").join(now.select(F.col("number").alias("other_number"), F.col("x").alias("ox"), F.col("y").alias("oy")), "other_number")
        force = F.when(F.col("pulls"), pull).otherwise(push)
        moves = pairs.groupBy("number").agg(F.sum(F.col("weight") * limited(force, "x")).alias("dx"), F.sum(F.col("weight") * limited(force, "y")).alias("dy"), F.sum(F.when(F.col("pulls"), F.col("weight"))).alias("total"))
        length = rate * (1 - step / steps)
        move = lambda c: F.col(c) + length * F.coalesce(F.col(f"d{c}") / F.greatest(F.col("total"), F.lit(1e-9)), F.lit(0.0))
        now, place = settled(now.join(moves, "number", "left").select("number", move("x").alias("x"), move("y").alias("y")), "step")
        if before is not None:
            remove(edges.sparkSession, before)
        before = place
    return numbered.select(key, "number").join(now, "number").select(key, "x", "y")


def scene_map(categories: DataFrame, *, k: int = NEIGHBOURS, steps: int = 25, spread: float = 10.0) -> DataFrame:
    """(genre, x, y) of categories (genre, centroid) by their graph of min(k, n - 1) neighbours; of fewer than three with a
    vector none. Vectors of different lengths are an error."""
    own, _ = settled(categories.where("centroid is not null and size(centroid) > 0").select("genre", "centroid"), "categories")
    n, widths = own.agg(F.count(F.lit(1)), F.count_distinct(F.size("centroid"))).first()
    if n >= LEAST and widths != 1:
        raise ValueError("the categories' vectors must share one dimension")
    first = scene(own)
    if n < LEAST:
        return first
    k = min(k, n - 1)
    edges = fuzzy_edges(neighbours(own, "genre", "centroid", k), "genre", k)
    # principal components, scaled to a square of 2 x spread; ties are parted by a hash
    most = first.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")), F.lit(1e-9)))
    scale = spread / most.first()[0]
    jitter = lambda seed: (F.pmod(F.xxhash64("genre", F.lit(seed)), F.lit(1000)) - 500) / 1e5
    start = first.select("genre", (F.col("x") * scale + jitter(1)).alias("x"), (F.col("y") * scale + jitter(2)).alias("y"))
    return laid_out(start, edges, "genre", steps=steps)


def kept_neighbours(places: DataFrame, near: DataFrame, key: str, k: int) -> float:
    """The share of each category's k nearest in `near` that are among its k nearest by place: a measure of a map."""
    around = neighbours(places.select(key, F.array(F.lit(1e3), "x", "y").alias("v")), key, "v", k)
    total = near.where(F.col("rank") <= k).count()
    return near.where(F.col("rank") <= k).join(around.select(key, "other"), [key, "other"], "left_semi").count() / max(total, 1)


def with_latest(places: DataFrame, metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Places with the metrics of the latest week, for categories that have both."""
    latest = metrics.join(F.broadcast(metrics.agg(F.max("week").alias("week"))), "week")
    return places.join(latest.select("genre", "week", *columns), "genre")
