"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > j) = logistic(x w - threshold j): one vector of weights for all grades over hashed text features, and ordered
thresholds between grades (each gap is the exponential of a free parameter). Features are hashed letter tokens and
hashed classes of a text's shape: shares of capitals, of symbols, of distinct words, of repeated neighbours, lengths.
The expected grade orders texts; the tail probability of a grade selects them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import document_rows, document_schema, with_rest
from tidemark.llm.labelled import LETTER, give_back, held_out, letter_runs, sampled
from tidemark.llm.text import Slice, hasher, laid_out, mix, text_column

U = np.uint64
DIMENSIONS = 1 << 15
#: Labelled rows that are learned from at most, by grade.
SAMPLE = 3000
#: Weight of a text's shape features beside its tokens', which have norm 1.
SHAPE = 0.7


def _share_class(part: np.ndarray, whole: np.ndarray, steps: int = 8) -> np.ndarray:
    """0 for none, then classes of equal width."""
    x = part / np.maximum(whole, 1)
    return np.where(part > 0, 1 + np.minimum((x * steps).astype(np.int64), steps - 1), 0)


def shape(s: Slice) -> np.ndarray:
    """(text, property): classes of the texts' shapes."""
    n = len(s.begins) - 1
    data = s.data
    sums = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][s.begins])
    letters = sums(LETTER[data])
    capitals = sums((data >= 65) & (data <= 90))
    digits = sums((data >= 48) & (data <= 57))
    symbols = sums((data > 32) & (data < 127) & ~LETTER[data] & ~np.isin(data, np.frombuffer(b"0123456789.,;:'\"-()", np.uint8)))
    bars = sums(data == ord("|"))
    lines = sums(data == 10)
    words = np.diff(s.bounds)
    hashes = hasher(301, True).ranges(data, s.starts, s.ends)
    doc = s.doc
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    distinct = np.bincount(d[np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])][: len(d)]], minlength=n)
    same = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]) if len(hashes) else np.zeros(0, bool)
    echoes = np.bincount(doc[1:][same], minlength=n)
    log = lambda x: np.log2(np.maximum(x, 1)).astype(np.int64)
    # distinct words are judged against what texts of the length usually have
    usual = np.minimum(words, 12 * np.power(np.maximum(words, 1), 0.6))
    return np.stack([log(words), _share_class(capitals, letters), _share_class(digits, letters + digits), _share_class(symbols, letters + symbols), _share_class(bars, words), _share_class(distinct, usual), _share_class(echoes, words), log(letters / np.maximum(words, 1) * 2), log(words / np.maximum(lines, 1)), (words == 0).astype(np.int64)], axis=1)


def text_features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: first row, number, and the features' texts, places and values."""
    tokens = hasher(302, True)
    for s in laid_out(column):
        n = len(s.begins) - 1
        starts, ends, doc = letter_runs(s)
        place = (tokens.ranges(s.data, starts, ends) >> U(49)).astype(np.int64)
        key, count = np.unique(doc * DIMENSIONS + place, return_counts=True)
        doc, place, value = key // DIMENSIONS, key % DIMENSIONS, np.sqrt(count)
        value = value / np.sqrt(np.bincount(doc, value * value, minlength=n))[doc]
        kinds = shape(s)
        k = kinds.shape[1]
        own = (mix((kinds + 1000 * np.arange(1, k + 1)).ravel().astype(U)) >> U(49)).astype(np.int64)
        yield s.first, n, np.r_[doc, np.repeat(np.arange(n), k)], np.r_[place, own], np.r_[value, np.full(n * k, SHAPE)]


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, latent: np.ndarray) -> np.ndarray:
        """(text, j): probability of a grade above j."""
        return 1 / (1 + np.exp(-(latent[:, None] - self.thresholds).clip(-40, 40)))

    @classmethod
    def fit(cls, doc: np.ndarray, place: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int, *, rounds: int = 150, penalty: float = 2e-4, rate: float = 0.05) -> Model:
        """Minimises the weighted negative log-likelihood with an L2 penalty by full gradient steps."""
        n = len(grade)
        weight = weight / weight.sum()
        free = np.r_[0.0, np.zeros(max(grades - 2, 0))]  # first threshold, logs of the gaps
        theta = np.zeros(DIMENSIONS + len(free))
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        rows = np.arange(n)
        for k in range(1, rounds + 1):
            w, free = theta[:DIMENSIONS], theta[DIMENSIONS:]
            gaps = np.exp(free[1:])
            thresholds = free[0] + np.r_[0.0, np.cumsum(gaps)]
            latent = np.bincount(doc, w[place] * value, minlength=n)
            above = np.c_[np.ones(n), cls(w, thresholds).above(latent), np.zeros(n)]
            hi, lo = above[rows, grade], above[rows, grade + 1]
            p = np.maximum(hi - lo, 1e-12)
            slope_hi, slope_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
            by_latent = -(slope_hi - slope_lo) * weight
            by_threshold = np.zeros(grades + 1)
            np.add.at(by_threshold, grade, slope_hi * weight)
            np.add.at(by_threshold, grade + 1, -slope_lo * weight)
            inner = by_threshold[1:grades]
            tails = np.cumsum(inner[::-1])[::-1]
            gradient = np.r_[np.bincount(place, by_latent[doc] * value, minlength=DIMENSIONS) + penalty * w, tails[:1], tails[1:] * gaps]
            mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient * gradient
            theta = theta - rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-10)
        free = theta[DIMENSIONS:]
        return cls(theta[:DIMENSIONS], free[0] + np.r_[0.0, np.cumsum(np.exp(free[1:]))])


def train(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, size: int = SAMPLE) -> Model | None:
    """Learns from a bounded sample of rated rows that are not held out; None if there is none."""
    own, _ = sampled(docs, ratings, grade, {g: size for g in range(grades)})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data: list[bytes] = [b""] * batch.num_rows
            for first, n, doc, place, value in text_features(text_column(batch.column("text"))):
                order = np.argsort(doc, kind="stable")
                bounds = np.searchsorted(doc[order], np.arange(n + 1))
                for i in range(n):
                    at = order[bounds[i] : bounds[i + 1]]
                    data[first + i] = place[at].astype("<u2").tobytes() + value[at].astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), batch.column("label"), batch.column("weight")], ["data", "grade", "weight"])

    rows = own.mapInArrow(packed, "data binary, grade int, weight double").orderBy(F.xxhash64("data"), "grade").toArrow()
    if not rows.num_rows:
        return None
    doc, place, value = [], [], []
    for i, data in enumerate(rows["data"].to_pylist()):
        k = len(data) // 6
        doc.append(np.full(k, i))
        place.append(np.frombuffer(data, "<u2", k).astype(np.int64))
        value.append(np.frombuffer(data, "<f4", k, 2 * k).astype(np.float64))
    model = Model.fit(*map(np.concatenate, (doc, place, value)), rows["grade"].to_numpy().astype(np.int64), rows["weight"].to_numpy(), grades)
    del rows, doc, place, value
    give_back()
    return model


def score_quality(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, *, tail: int = 1, least: float = 0.5, size: int = SAMPLE) -> DataFrame:
    """The columns of docs with held_out, expected_grade, tail_probability (of a grade of at least `tail`) and keep.

    grade is a column of ratings with the grades 0 to grades - 1 (null: not rated). keep is tail_probability >= least.
    Scores depend on texts only; a null text counts as empty. Without any rated row all texts have the expected grade of
    even chances and are kept. Columns of docs with the new names are replaced.
    """
    rows = document_rows(docs)
    found = train(docs, ratings, grade, grades, size) or Model(np.zeros(DIMENSIONS), np.zeros(grades - 1))
    model = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            latent = np.zeros(batch.num_rows)
            for first, n, doc, place, value in text_features(text_column(batch.column("text"))):
                latent[first : first + n] = np.bincount(doc, own.weights[place] * value, minlength=n)
            above = own.above(latent)
            chance = above[:, tail - 1] if tail > 0 else np.ones(len(latent))
            columns = {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "rest": batch.column("rest"), "expected_grade": pa.array(above.sum(axis=1)), "tail_probability": pa.array(chance), "keep": pa.array(chance >= least)}
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    scored = rows.mapInArrow(run, document_schema(rows, "expected_grade double, tail_probability double, keep boolean"))
    return with_rest(scored.withColumn("held_out", held_out(F.col("doc_id"))), docs, "held_out", "expected_grade", "tail_probability", "keep")
