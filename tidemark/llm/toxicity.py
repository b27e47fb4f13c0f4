"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, and weighted votes.

Terms are tokens (runs of letters, A-Z lower-cased) and their prefixes; the vocabulary has every term of at least
LEAST_TEXTS training texts. A text is mostly words that say nothing about its label, so that a term's inverse document
frequency is multiplied by the square of the logarithm of its odds (toxic to other training texts, smoothed): no term is
chosen or left out, but those that occur alike under both labels weigh little. The unit vectors of the training texts are
indexed: postings by term, those of frequent terms by blocks of examples with the largest weight of each. A query bounds
every block by its own weights times those maxima, scores the blocks of the highest bounds, and then those only that can
still hold a nearer example; the result is that of a full scan. Votes are weighted by nearness; scores are calibrated by isotonic regression
on the training texts, each scored without itself. A text without any known term gets the share of toxic texts among the
training texts without any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, document_rows, document_schema, give_up, trim, with_rest
from tidemark.llm.labelled import give_back, held_out, letter_runs, sampled
from tidemark.llm.text import hasher, laid_out, mix, text_column

U = np.uint64
#: Labelled rows that are learned from at most, by label.
SAMPLE = {1: 2000, 0: 6000}
PREFIXES = (5,)
#: Neighbours that vote, examples of a block, and training texts that a term of the vocabulary is in at least.
NEAREST, BLOCK, LEAST_TEXTS = 15, 256, 2
#: Share of the examples (one in so many) from which on a term is frequent, texts that search at once, and decimals of
#: cosines (sums in different orders agree in them).
FREQUENT, TEXTS, DIGITS = 12, 128, 9
#: Texts of average odds that every term is counted with besides its own.
SMOOTH = 10.0
THRESHOLD = 0.3


def text_terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of texts: the first one's row, their number, each term's text in the slice, and its hash."""
    own = hasher(201, True)
    for s in laid_out(column, words=False):
        starts, ends, doc = letter_runs(s)
        owner, terms = [doc], [own.ranges(s.data, starts, ends)]
        for k in PREFIXES:
            long = ends - starts > k
            owner.append(doc[long])
            terms.append(mix(own.ranges(s.data, starts[long], starts[long] + k) + U(k)))
        yield s.first, len(s.begins) - 1, np.concatenate(owner), np.concatenate(terms)


def _counted(owner: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (text, term) and how often each occurs."""
    order = np.lexsort((terms, owner))
    owner, terms = owner[order], terms[order]
    at = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (terms[1:] != terms[:-1])][: len(owner)])
    return owner[at], terms[at], np.diff(np.r_[at, len(owner)])


def ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each begin and count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - counts), counts)


def term_weights(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, smooth: float = SMOOTH) -> np.ndarray:
    """Inverse document frequency times squared log odds of terms, by the numbers of toxic and other texts with them;
    the frequency alone if there are texts of one label only."""
    n = n_toxic + n_other
    idf = np.log((n + 1) / (toxic + other + 1)) + 1
    if not n_toxic or not n_other:
        return idf
    a = (toxic + smooth * n_toxic / n) / (n_toxic + smooth)
    b = (other + smooth * n_other / n) / (n_other + smooth)
    return idf * np.log(a / b) ** 2


class Vocabulary:
    """Sorted term hashes with their weights."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        self.terms, self.weights = terms, weights

    def vectors(self, owner: np.ndarray, terms: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term's place, weight, text): unit TF-IDF vectors of the texts that have known terms."""
        if not len(self.terms):
            return np.zeros(0, np.int32), np.zeros(0, np.float32), owner[:0]
        place = np.searchsorted(self.terms, terms).clip(max=len(self.terms) - 1)
        own = self.terms[place] == terms
        owner, place, count = owner[own], place[own], count[own]
        value = (1 + np.log(count.astype(np.float64))) * self.weights[place]
        norm = np.sqrt(np.bincount(owner, value * value))[owner] if len(owner) else value
        some = norm > 0
        return place[some].astype(np.int32), (value[some] / norm[some]).astype(np.float32), owner[some]


class Index:
    """Examples' vectors by term. Postings of terms in few examples are short and read whole; those of frequent terms
    (in at least one of FREQUENT examples) are kept by blocks of examples, with each term's largest weight in a block."""

    def __init__(self, example: np.ndarray, place: np.ndarray, value: np.ndarray, label: np.ndarray, share: float, terms: int):
        """Vectors' entries in the order of their examples. They are kept and sent in single precision, as they come, and
        widened where they are used."""
        order = np.argsort(place, kind="stable")
        example, place, value = example[order].astype(np.int32), place[order], value[order].astype(np.float32)
        del order
        self.label, self.share, self.n = label, share, len(label)
        count = np.bincount(place, minlength=terms)
        often = count * FREQUENT >= max(self.n, 1)
        #: Each frequent term's row among them, or -1; their weights by (row, example), and the blocks' maxima.
        self.row = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        self.blocks = -(-self.n // BLOCK)
        self.weights = np.zeros((int(often.sum()), self.blocks * BLOCK), np.float32)
        here = often[place]
        self.weights[self.row[place[here]], example[here]] = value[here]
        self.most = self.weights.reshape(len(self.weights), self.blocks, BLOCK).max(axis=2) if self.n else np.zeros((len(self.weights), 0), np.float32)
        self.posting, self.value = example[~here], value[~here]
        self.size = np.where(often, 0, count)
        self.begin = np.cumsum(self.size) - self.size

    def widened(self) -> None:
        if self.posting.dtype != np.int64:
            self.posting = self.posting.astype(np.int64)
            self.weights, self.most, self.value = (x.astype(np.float64) for x in (self.weights, self.most, self.value))

    def nearest(self, owner: np.ndarray, place: np.ndarray, value: np.ndarray, n: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of n texts (vectors by owner) its examples and cosines (to DIGITS decimals), nearest first (ties: lower
        number), at most NEAREST of them, none with a cosine of 0, and not the one of its number in `without`."""
        self.widened()
        out: list[tuple[np.ndarray, np.ndarray]] = []
        bounds = np.searchsorted(owner, np.arange(n + 1))
        for lo in range(0, n, TEXTS):
            hi = min(lo + TEXTS, n)
            at = slice(bounds[lo], bounds[hi])
            out += self._batch(owner[at] - lo, place[at], value[at].astype(np.float64), hi - lo, None if without is None else without[lo:hi])
        return out

    def _batch(self, owner: np.ndarray, place: np.ndarray, value: np.ndarray, n: int, without: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        width = self.blocks * BLOCK
        size, begin = self.size[place], self.begin[place]
        scores = np.zeros((n, width))
        bounds = np.searchsorted(owner, np.arange(n + 1))
        for i in range(n):  # text by text, in the processor's cache
            own = slice(bounds[i], bounds[i + 1])
            at = ranges(begin[own], size[own])
            scores[i] = np.bincount(self.posting[at], np.repeat(value[own], size[own]) * self.value[at], minlength=width)
        query = np.zeros((n, len(self.weights)))
        often = self.row[place] >= 0
        query[owner[often], self.row[place[often]]] = value[often]
        if without is not None:
            scores[np.arange(n), without] = -np.inf
        bound = (scores.reshape(n, self.blocks, BLOCK).max(axis=2) + query @ self.most) * (1 + 1e-9) if self.blocks else np.zeros((n, 0))
        seen = np.zeros(bound.shape, bool)
        first = max(1, self.blocks // 8)
        wanted = bound >= np.partition(bound, self.blocks - first, axis=1)[:, [self.blocks - first]] if self.blocks else seen
        done = np.full(scores.shape, -np.inf)
        edge = np.zeros((n, 1))
        for again in (False, True):  # the blocks of the highest bounds, then those that can still hold a nearer example
            wanted = wanted & ~seen & (bound > 0)
            for b in np.flatnonzero(wanted.any(axis=0)):
                texts, own = np.flatnonzero(wanted[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                done[texts, own] = scores[texts, own] + query[texts] @ self.weights[:, own]
            if not again:
                seen |= wanted
                if width > NEAREST:  # the last of the nearest so far: none that is farther can be among them
                    edge = np.maximum(np.partition(done, width - NEAREST, axis=1)[:, [width - NEAREST]], 0)
                wanted = bound >= edge
        found = []
        for row, least in zip(done, edge[:, 0] - 0.1**DIGITS, strict=True):
            ids = np.flatnonzero(row >= max(least, 0))
            near = np.round(row[ids], DIGITS)
            best = np.lexsort((ids, -near))[:NEAREST]
            best = best[near[best] > 0]
            found.append((ids[best], near[best]))
        return found

    def vote(self, ids: np.ndarray, near: np.ndarray) -> float:
        w = near * near
        return float((w @ (self.label[ids] > 0) + 0.25 * self.share) / (w.sum() + 0.25))


@dataclass
class Calibration:
    """The score of a vote: isotonic levels between knots; the score of a text without known terms."""

    knots: np.ndarray
    levels: np.ndarray
    bare: float

    @classmethod
    def fit(cls, raw: np.ndarray, label: np.ndarray, weight: np.ndarray, share: float, bare: float) -> Calibration:
        """Pools adjacent violators; each pool starts with a grain of the overall share."""
        pools: list[list[float]] = []
        values, at = np.unique(raw, return_inverse=True)
        ones, all_of = (np.bincount(at, w, minlength=len(values)) for w in (weight * (label > 0), weight))
        for x, y, w in zip(values.tolist(), ones.tolist(), all_of.tolist(), strict=True):
            pools.append([y, w, x, x])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                last = pools.pop()
                pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
        levels = [(p[0] + share) / (p[1] + 1) for p in pools for _ in range(2)]
        return cls(np.array([v for p in pools for v in (p[2], p[3])] or [0.0]), np.maximum.accumulate(np.array(levels or [share])), bare)

    def score(self, raw: float) -> float:
        return float(np.interp(raw, self.knots, self.levels))


#: A term of a text: 64 bits of hash, 32 bits of count. A term of a vector: its place and its weight.
TERM, ENTRY = np.dtype([("term", "<u8"), ("count", "<u4")]), np.dtype([("place", "<i4"), ("value", "<f4")])


@dataclass
class Model:
    vocabulary: Broadcast
    index: Broadcast
    calibration: Calibration


def train(docs: DataFrame, labels: DataFrame, sizes: dict[int, int] | None = None) -> Model:
    """Learns from a bounded sample of the labelled rows that are not held out (labels: doc_id, toxic).

    Texts of equal terms are one example, with the largest of their labels. Examples are ordered by label, heaviest term
    and a digest of their terms, so that every run learns the same model from the same rows. The driver gets the
    vocabulary's counts and the examples' vectors, which the sample bounds.
    """
    spark = docs.sparkSession
    own, _ = sampled(docs, labels, F.when(F.col("toxic") > 0, 1).otherwise(F.when(F.col("toxic") == 0, 0)), sizes or SAMPLE)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for batch in batches:
            terms: list[bytes] = [b""] * batch.num_rows
            for first, n, owner, hashes in text_terms(text_column(batch.column("text"))):
                owner, hashes, count = _counted(owner, hashes)
                rows = np.empty(len(hashes), TERM)
                rows["term"], rows["count"] = hashes, count
                bounds = np.searchsorted(owner, np.arange(n + 1))
                for i in range(n):
                    terms[first + i] = rows[bounds[i] : bounds[i + 1]].tobytes()
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in terms]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(terms, pa.binary()), batch.column("label"), batch.column("weight")], ["digest", "terms", "label", "weight"])

    examples = own.mapInArrow(packed, "digest binary, terms binary, label int, weight double")
    examples = checkpoint(examples.groupBy("digest").agg(F.max(F.struct("label", "weight")).alias("of"), F.max("terms").alias("terms")).select("digest", "terms", "of.*"))

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, y in zip(batch.column("terms").to_pylist(), batch.column("label").to_pylist(), strict=True):
                found = np.frombuffer(data, TERM)["term"].astype(U).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), y > 0))], ["term", "toxic"])

    counted = examples.mapInArrow(long, "term long, toxic boolean").groupBy("term").agg(F.count_if("toxic").cast("int").alias("a"), F.count_if(~F.col("toxic")).cast("int").alias("b"))
    known = counted.where(F.col("a") + F.col("b") >= LEAST_TEXTS).toArrow()
    terms, a, b = known["term"].to_numpy().view(U), known["a"].to_numpy(), known["b"].to_numpy()
    order = np.argsort(terms)
    n_toxic, n = examples.agg(F.count_if(F.col("label") > 0), F.count(F.lit(1))).first()
    vocabulary = spark.sparkContext.broadcast(Vocabulary(terms[order], term_weights(a[order], b[order], n_toxic, n - n_toxic)))
    known_terms = len(terms)
    del known, terms, a, b, order
    give_back()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, heaviest = [], []
            for data in batch.column("terms").to_pylist():
                rows = np.frombuffer(data, TERM)
                place, value, _ = vocabulary.value.vectors(np.zeros(len(rows), np.int64), rows["term"].astype(U), rows["count"])
                vector = np.empty(len(place), ENTRY)
                vector["place"], vector["value"] = place, value
                out.append(vector.tobytes())
                heaviest.append(int(place[np.argmax(value)]) if len(place) else -1)
            kept = [batch.column(c) for c in ("digest", "label", "weight")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(heaviest, pa.int32()), pa.array(out, pa.binary())], ["digest", "label", "weight", "heaviest", "vector"])

    placed = checkpoint(examples.mapInArrow(vectors, "digest binary, label int, weight double, heaviest int, vector binary"))
    rows = placed.toArrow().sort_by([("label", "ascending"), ("heaviest", "ascending"), ("digest", "ascending")])
    label, weight = rows["label"].to_numpy(), rows["weight"].to_numpy()
    share = float((label * weight).sum() / weight.sum()) if len(label) else 0.0
    number = {d: i for i, d in enumerate(rows["digest"].to_pylist())}
    data = rows["vector"].to_pylist()
    del rows
    owner = np.repeat(np.arange(len(label), dtype=np.int32), [len(x) // ENTRY.itemsize for x in data])
    entries = np.frombuffer(b"".join(data), ENTRY)
    del data
    index = spark.sparkContext.broadcast(Index(owner, entries["place"], entries["value"], label, share, known_terms))
    del entries, owner
    give_back()

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The votes on each example without itself."""
        give_up()
        for batch in batches:
            ids = [number[d] for d in batch.column("digest").to_pylist()]
            size = np.array([len(x) // ENTRY.itemsize for x in batch.column("vector").to_pylist()], np.int64)
            entries = np.frombuffer(b"".join(batch.column("vector").to_pylist()), ENTRY)
            near = index.value.nearest(np.repeat(np.arange(len(ids)), size), entries["place"], entries["value"], len(ids), np.array(ids))
            raw = [index.value.vote(*x) if k else None for x, k in zip(near, size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(raw, pa.float64())], ["number", "raw"])

    known = placed.select("digest", "vector").mapInArrow(votes, "number int, raw double").where("raw is not null").toArrow().sort_by("number")
    at = known["number"].to_numpy()
    without = np.ones(len(label), bool)
    without[at] = False
    bare = float((label * weight)[without].sum() + share) / float(weight[without].sum() + 1) if len(label) else 0.0
    model = Model(vocabulary, index, Calibration.fit(known["raw"].to_numpy(), label[at], weight[at], share, bare))
    del known
    give_back()
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sizes: dict[int, int] | None = None) -> DataFrame:
    """The columns of docs with held_out, score (0 to 1), predicted (score >= threshold) and evidence.

    evidence has, for each of the nearest examples, its cosine and label, nearest first; it is empty for texts without
    known terms, such as null and empty ones. Without any labelled row all scores are 0. Scores depend on texts only:
    equal texts, repeated rows and rows without doc_id (never held out) score alike, whole texts of any length are
    read. Columns of docs with the new names are replaced; an empty table gives an empty one.
    """
    rows = document_rows(docs)
    model = train(docs, labels, sizes)
    vocabulary, index, calibration = model.vocabulary, model.index, model.calibration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for batch in batches:
            score = np.full(batch.num_rows, calibration.bare)
            counts = np.zeros(batch.num_rows + 1, np.int32)
            cosines, voters = [np.zeros(0)], [np.zeros(0, np.int32)]
            for first, n, owner, terms in text_terms(text_column(batch.column("text"))):
                place, value, owner = vocabulary.value.vectors(*_counted(owner, terms))
                known = np.unique(owner)
                searched = index.value.nearest(np.searchsorted(known, owner), place, value, len(known))
                for i, (ids, near) in zip(known.tolist(), searched, strict=True):
                    score[first + i] = calibration.score(index.value.vote(ids, near))
                    counts[first + i + 1] = len(ids)
                    cosines.append(near)
                    voters.append(index.value.label[ids].astype(np.int32))
            score = score.clip(0, 1)
            evidence = pa.StructArray.from_arrays([pa.array(np.concatenate(cosines)), pa.array(np.concatenate(voters))], ["cosine", "label"])
            columns = {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "rest": batch.column("rest"), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}
            columns["evidence"] = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), evidence)
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])
            del columns, evidence
            cosines = voters = batch = None
            trim()

    scored = rows.mapInArrow(run, document_schema(rows, "score double, predicted int, evidence array<struct<cosine: double, label: int>>"))
    scored = scored.withColumn("held_out", held_out(F.col("doc_id")))
    return with_rest(scored, docs, "held_out", "score", "predicted", "evidence")
