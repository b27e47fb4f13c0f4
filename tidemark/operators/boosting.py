"""Gradient-boosted trees under pinball loss: many pooled quantile models fitted at once.

A model is a key (say: axis, horizon, origin of the fit) and a quantile; all are grown level by level in the same passes.
Examples are turned into numbers of bins once, and dealt to as many tasks as their number is worth. A pass evaluates the
trees so far on every example, in Arrow batches; a task counts its own, and Spark sums a histogram of (model, node, feature,
bin): how many examples, and how many lie below their prediction. The gradient of pinball loss has only these two values,
so that histograms are counts and every run grows the same trees. The driver sees histograms, whose size is set by the
parameters and the number of models, and never an example. A grown tree's leaves move to the quantile of their residuals.
Models of few examples (WHOLE at most) need no passes: their keys are spread over tasks, and their trees grow there in the
same way, from exact quantiles, so that they do not depend on how the examples are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.1, 0.5, 0.9)
#: Examples that a model needs at least, and examples in a leaf.
LEAST, LEAF = 16, 3
#: Accuracy of quantiles over many rows: ranks are right to 1 / ACCURACY.
ACCURACY = 10_000
#: Examples that are worth a task of a pass, and examples that a model has at most to be grown within a task.
ROWS, WHOLE = 16_384, 32_768


@dataclass
class Tree:
    """A complete binary tree in heap order: nodes 1 to 2**depth - 1 split, the following 2**depth are leaves. An example
    goes right if its bin of `feature` is over `edge`."""

    feature: np.ndarray
    edge: np.ndarray
    leaf: np.ndarray

    def node(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """The nodes that examples reach after `depth` splits."""
        at = np.ones(len(codes), np.int64)
        for _ in range(depth):
            at = 2 * at + (codes[np.arange(len(codes)), self.feature[at]] > self.edge[at])
        return at


@dataclass
class Boosted:
    """Fitted models: edges of the features' bins by key, and by key and quantile a start and trees."""

    features: list[str]
    keys: list[str]
    quantiles: tuple[float, ...]
    depth: int
    rate: float
    edges: dict[tuple, list[np.ndarray]] = field(default_factory=dict)
    start: dict[tuple, np.ndarray] = field(default_factory=dict)
    trees: dict[tuple, list[list[Tree]]] = field(default_factory=dict)  # by key: for each quantile its trees

    def codes(self, key: tuple, values: np.ndarray) -> np.ndarray:
        return bins_of(self.edges[key], values)

    def values(self, key: tuple, codes: np.ndarray) -> np.ndarray:
        """Predictions of all quantiles, one column each, by the trees so far."""
        out = np.repeat(self.start[key][None, :], len(codes), axis=0)
        for q, trees in enumerate(self.trees[key]):
            for tree in trees:
                out[:, q] += self.rate * tree.leaf[tree.node(codes, self.depth) - (1 << self.depth)]
        return out


def bins_of(edges: Sequence[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Bins of feature values (one column a feature); 0 where a value is missing."""
    out = np.zeros(values.shape, np.int64)
    for j, own in enumerate(edges):
        known = np.isfinite(values[:, j])
        out[known, j] = 1 + np.searchsorted(own, values[known, j], "left")
    return out


def at_ranks(values: np.ndarray, shares: Sequence[float]) -> np.ndarray:
    """The values whose ranks are the least that cover the shares."""
    ranks = np.ceil(np.asarray(shares) * len(values)).astype(np.int64)
    return np.sort(values)[np.maximum(ranks - 1, 0)]


def examples_of(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """(key, x, y): the features as one array, without rows that lack a target."""
    own = df.where(F.col(target).isNotNull() & ~F.isnan(target))
    return own.select(F.struct(*keys).alias("key"), F.array(*(F.col(c).cast("double") for c in features)).alias("x"), F.col(target).cast("double").alias("y"))


def summed(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, feature, bin, n, below) of cells that were counted in parts."""
    return cells.groupBy(*by, "feature", "bin").agg(F.sum("n").alias("n"), F.sum("below").alias("below"))


def histogram(state: DataFrame, by: Sequence[str] = ("model", "q", "node")) -> DataFrame:
    """(by, feature, bin, n, below) of rows (by, below, codes): counts of examples and of those that lie below their
    prediction, for the bins of each feature."""
    return summed(state.select(*by, F.lit(1).alias("n"), F.col("below").cast("long").alias("below"), F.posexplode("codes").alias("feature", "bin")), by)


def best_splits(n: np.ndarray, below: np.ndarray, quantile: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, bin edge and whether there is a gain at all, for counts (node, feature, bin) and the nodes' quantiles; both
    sides have at least LEAF examples. Ties go to the first feature, then the first edge."""
    left_n, left_b = np.cumsum(n, axis=2)[:, :, :-1], np.cumsum(below, axis=2)[:, :, :-1]
    total_n, total_b = n.sum(axis=2, keepdims=True), below.sum(axis=2, keepdims=True)
    quantile = quantile[:, None, None]
    score = lambda count, less: (quantile * count - less) ** 2 / (count + ridge)
    gain = score(left_n, left_b) + score(total_n - left_n, total_b - left_b) - score(total_n, total_b)
    gain = np.where((left_n >= LEAF) & (total_n - left_n >= LEAF), gain, -np.inf).reshape(len(n), -1)
    most = gain.max(axis=1)
    at = np.argmax(gain >= most[:, None] - 1e-9, axis=1)
    return at // left_n.shape[2], at % left_n.shape[2], most > 1e-9


def _key(row) -> tuple:
    return tuple(row) if not isinstance(row, dict) else tuple(row.values())


def fit(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, *, quantiles: Sequence[float] = QUANTILES, rounds: int = 12, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 0.1, whole: int = WHOLE) -> Boosted:
    """Models for each value of keys in df, from its rows with a target. A key with fewer than LEAST rows has no model.

    Jobs: 1 for the counts, 1 for all models of up to `whole` examples; for the others together 1 for the bins, then `depth`
    and 1 more a round.
    """
    model, large = (Boosted(list(features), list(keys), tuple(quantiles), depth, rate) for _ in range(2))
    most, total = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 0
    own = examples_of(df, keys, features, target).repartition(most).persist()
    try:
        for row in own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).collect():
            to = model if row["n"] <= whole else large
            to.trees[_key(row["key"])] = [[] for _ in quantiles]
            total += row["n"] if to is large else 0
        if model.trees:
            _grow_whole(_numbered(own, model), model, rounds, bins, ridge)
        if large.trees:
            _grow(_numbered(own, large).repartition(max(1, min(most, -(-total // ROWS)))), large, rounds, bins, ridge)
    finally:
        own.unpersist()
    for kept, more in ((model.edges, large.edges), (model.start, large.start), (model.trees, large.trees)):
        kept.update(more)
    return model


def _grow(examples: DataFrame, model: Boosted, rounds: int, bins: int, ridge: float) -> None:
    """Grows the trees of all models in shared passes over their examples (model, x, y)."""
    known, size, many = list(model.trees), 1 << model.depth, len(model.quantiles)
    examples, coded = examples.persist(), None
    try:
        parts = [i / bins for i in range(1, bins)]
        edges = [F.percentile_approx(F.when(~F.isnan(F.col("x")[j]), F.col("x")[j]), parts, ACCURACY).alias(f"e{j}") for j in range(len(model.features))]
        for row in examples.groupBy("model").agg(F.percentile_approx("y", list(model.quantiles), ACCURACY).alias("start"), *edges).collect():
            key = known[row["model"]]
            model.edges[key] = [np.unique(np.array(row[f"e{j}"] or [], float)) for j in range(len(model.features))]
            model.start[key] = np.array(row["start"], float)
        coded = _coded(examples, model).persist()
        for _ in range(rounds):
            for trees in model.trees.values():
                for own_trees in trees:
                    # until a node is split, all go left
                    own_trees.append(Tree(np.zeros(size, np.int64), np.full(size, 1 << 30), np.zeros(size)))
            for level in range(model.depth):
                nodes = 1 << level
                found = summed(_cells(coded, model, level, bins + 1), ["model", "q", "node"]).toArrow()
                m, q, node, feature, code, n, below = (found[c].to_numpy() for c in ("model", "q", "node", "feature", "bin", "n", "below"))
                counts = np.zeros((2, len(known), many, nodes, len(model.features), bins + 1))
                counts[:, m, q, node - nodes, feature, code] = n, below
                counts = counts.reshape(2, -1, len(model.features), bins + 1)
                split_f, split_b, gains = best_splits(*counts, np.tile(np.repeat(model.quantiles, nodes), len(known)), ridge)
                for i in np.flatnonzero(gains):
                    m, q, node = np.unravel_index(i, (len(known), many, nodes))
                    tree = model.trees[known[m]][q][-1]
                    tree.feature[nodes + node], tree.edge[nodes + node] = split_f[i], split_b[i]
            moved = _residuals(coded, model).groupBy("model", "q", "node").agg(F.percentile_approx("residual", list(model.quantiles), ACCURACY).alias("move"))
            for row in moved.collect():
                model.trees[known[row["model"]]][row["q"]][-1].leaf[row["node"] - size] = row["move"][row["q"]]
    finally:
        examples.unpersist()
        if coded is not None:
            coded.unpersist()


def _grow_whole(examples: DataFrame, model: Boosted, rounds: int, bins: int, ridge: float) -> None:
    """Grows the trees of models of few examples (model, x, y), each within a task; bins and trees alone are returned."""
    known, size, many, depth, rate, width = list(model.trees), 1 << model.depth, len(model.quantiles), model.depth, model.rate, len(model.features)
    quantiles, parts = np.array(model.quantiles), [i / bins for i in range(1, bins)]

    def one(table: pa.Table) -> pa.Table:
        x, y = _matrix(table["x"].combine_chunks(), width), table["y"].to_numpy()
        edges = [np.unique(at_ranks(c[~np.isnan(c)], parts)) if (~np.isnan(c)).any() else np.array([]) for c in x.T]
        codes, start = bins_of(edges, x), at_ranks(y, quantiles)
        rows, q = np.arange(len(y))[:, None], np.arange(many)[None, :]
        value, out = np.repeat(start[None, :], len(y), axis=0), []
        for _ in range(rounds):
            feature, edge, leaf = np.zeros((many, size), np.int64), np.full((many, size), 1 << 30), np.zeros((many, size))
            residual, at = y[:, None] - value, np.ones(value.shape, np.int64)
            for level in range(depth):
                nodes = 1 << level
                shape = (many * nodes, width, bins + 1)
                cells = ((q * nodes + at - nodes)[:, :, None] * width + np.arange(width)) * (bins + 1) + codes[:, None, :]
                n, below = (np.bincount(c.ravel(), minlength=int(np.prod(shape))).reshape(shape).astype(float) for c in (cells, cells[residual < 0]))
                split_f, split_b, gains = best_splits(n, below, np.repeat(quantiles, nodes), ridge)
                for i in np.flatnonzero(gains):
                    feature[i // nodes, nodes + i % nodes], edge[i // nodes, nodes + i % nodes] = split_f[i], split_b[i]
                at = 2 * at + (codes[rows, feature[q, at]] > edge[q, at])
            for k in range(many):
                for node in np.unique(at[:, k]):
                    leaf[k, node - size] = at_ranks(residual[at[:, k] == node, k], quantiles[k : k + 1])[0]
            value = value + rate * leaf[q, at - size]
            out.append((feature, edge, leaf))
        lists = [np.array([t[i] for t in out]).ravel() for i in range(3)]
        return pa.table({"model": table["model"][:1], "start": [start], "edges": [edges], **{c: [v] for c, v in zip(("feature", "edge", "leaf"), lists, strict=True)}})

    kinds = "model int, start array<double>, edges array<array<double>>, feature array<long>, edge array<long>, leaf array<double>"
    for row in examples.groupBy("model").applyInArrow(one, kinds).collect():
        key = known[row["model"]]
        model.start[key], model.edges[key] = np.array(row["start"]), [np.array(e, float) for e in row["edges"]]
        feature, edge, leaf = (np.array(row[c]).reshape(-1, many, size) for c in ("feature", "edge", "leaf"))
        model.trees[key] = [[Tree(feature[r, k], edge[r, k], leaf[r, k]) for r in range(rounds)] for k in range(many)]


def _numbered(examples: DataFrame, model: Boosted) -> DataFrame:
    """(model, x, y): the number of an example's key; without those whose key has no model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {k: i for i, k in enumerate(model.trees)}
        for batch in batches:
            which = np.array([number.get(_key(k), -1) for k in batch["key"].to_pylist()], np.int32)
            some = pa.array(np.flatnonzero(which >= 0))
            yield pa.RecordBatch.from_arrays([pa.array(which).take(some), batch["x"].take(some), batch["y"].take(some)], ["model", "x", "y"])

    return examples.mapInArrow(run, "model int, x array<double>, y double")


def _coded(examples: DataFrame, model: Boosted) -> DataFrame:
    """(model, codes, y): the bins of the examples' features."""
    width = len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = list(model.trees)
        for batch in batches:
            x, which, codes = _matrix(batch["x"], width), batch["model"].to_numpy(), np.zeros((batch.num_rows, width), np.int32)
            for i in np.unique(which):
                codes[which == i] = model.codes(known[i], x[which == i])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * width), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch["model"], lists, batch["y"]], ["model", "codes", "y"])

    return examples.mapInArrow(run, "model int, codes array<int>, y double")


class _Grown:
    """The trees of all models so far, as arrays of (tree, model, quantile, node): a pass follows them for all examples of a
    batch at once."""

    def __init__(self, model: Boosted) -> None:
        self.rate, self.depth, self.width = model.rate, model.depth, len(model.features)
        self.start = np.array([model.start[k] for k in model.trees])
        each = list(zip(*(trees for own in model.trees.values() for trees in own), strict=True))
        shape = (len(each), *self.start.shape, 1 << model.depth)
        self.feature, self.edge, self.leaf = (np.array([[getattr(t, c) for t in trees] for trees in each]).reshape(shape) for c in ("feature", "edge", "leaf"))

    def follow(self, batch: pa.RecordBatch, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch of coded examples: models, codes, and by quantile residuals and the nodes of the last tree's level."""
        which, codes = batch["model"].to_numpy(), batch["codes"].flatten().to_numpy().reshape(-1, self.width)
        rows, q = np.arange(len(which))[:, None], np.arange(self.start.shape[1])[None, :]
        many, value = which[:, None], self.start[which]

        def node(tree: int, depth: int) -> np.ndarray:
            at = np.ones(value.shape, np.int64)
            for _ in range(depth):
                at = 2 * at + (codes[rows, self.feature[tree, many, q, at]] > self.edge[tree, many, q, at])
            return at

        # the last tree's leaves are still 0
        for tree in range(len(self.feature) - 1):
            value = value + self.rate * self.leaf[tree, many, q, node(tree, self.depth) - (1 << self.depth)]
        return which, codes, batch["y"].to_numpy()[:, None] - value, node(-1, level)


def _cells(coded: DataFrame, model: Boosted, level: int, bins: int) -> DataFrame:
    """(model, q, node, feature, bin, n, below): a task's counts of its own examples at the last tree's nodes of a level."""
    grown, nodes = _Grown(model), 1 << level
    shape = (*grown.start.shape, nodes, grown.width, bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, int(np.prod(shape))), np.int64)
        for batch in batches:
            which, codes, residual, at = grown.follow(batch, level)
            for q in range(shape[1]):
                cell = ((((which * shape[1] + q) * nodes + at[:, q] - nodes) * grown.width)[:, None] + np.arange(grown.width)) * bins + codes
                for k, some in enumerate((cell, cell[residual[:, q] < 0])):
                    counts[k] += np.bincount(some.ravel(), minlength=counts.shape[1])
        held = np.flatnonzero(counts[0])
        m, q, node, feature, code = np.unravel_index(held, shape)
        columns = [*(x.astype(np.int32) for x in (m, q, node + nodes, feature, code)), *counts[:, held]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["model", "q", "node", "feature", "bin", "n", "below"])

    return coded.mapInArrow(run, "model int, q int, node int, feature int, bin int, n long, below long")


def _residuals(coded: DataFrame, model: Boosted) -> DataFrame:
    """(model, q, node, residual): every example under every quantile, at the last tree's leaf."""
    grown = _Grown(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, _, residual, at = grown.follow(batch, grown.depth)
            n, many = residual.shape
            columns = [np.repeat(which, many), np.tile(np.arange(many, dtype=np.int32), n), at.ravel().astype(np.int32), residual.ravel()]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["model", "q", "node", "residual"])

    return coded.mapInArrow(run, "model int, q int, node int, residual double")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _by_key(keys: Sequence[tuple]) -> dict[tuple, np.ndarray]:
    rows: dict[tuple, list[int]] = {}
    for i, k in enumerate(keys):
        rows.setdefault(k, []).append(i)
    return {k: np.array(v) for k, v in rows.items()}


def forecast(df: DataFrame, model: Boosted) -> DataFrame:
    """df with low, predicted and high, from the models of three quantiles; rows whose key has no model are left out.

    Quantiles do not cross: low is the least of the three values and high the largest.
    """
    own = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("row"), F.struct(*model.keys).alias("key"), F.array(*(F.col(c).cast("double") for c in model.features)).alias("x"))
    width = len(model.features)
    row_kind = own.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["x"], width)
            out = np.full((batch.num_rows, 3), np.nan)
            for key, rows in _by_key([_key(k) for k in batch["key"].to_pylist()]).items():
                if key in model.trees:
                    out[rows] = model.values(key, model.codes(key, x[rows]))
            some = np.flatnonzero(np.isfinite(out[:, 0]))
            found = out[some]
            yield pa.RecordBatch.from_arrays([batch["row"].take(pa.array(some)), pa.array(found.min(axis=1, initial=np.inf)), pa.array(found[:, 1].copy()), pa.array(found.max(axis=1, initial=-np.inf))], ["row", "low", "predicted", "high"])

    if len(model.quantiles) != 3:
        raise ValueError("low, point and high are three quantiles")
    return own.mapInArrow(run, f"row {row_kind}, low double, predicted double, high double").select("row.*", "low", "predicted", "high")


def last_cut(cuts: Sequence, origin: Column) -> Column:
    """The latest of the cuts that is not after the origin; NULL before the first."""
    return F.array_max(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= origin))
