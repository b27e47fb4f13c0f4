"""LM scoring by subword lattices: the probability of a document summed over all segmentations into vocabulary pieces.

A document is its words, each with a space before it, and an end. Pieces of an existing vocabulary have unigram
probabilities; as no piece spans a space inside, the sum over all segmentations of a document is the product of those of
its words, and a word's is the last value of the forward recursion over its lattice (lattice.py), in log space.

The vocabulary files at hand have ranks but no unigram scores, so these are learned from the training documents by
expectation maximisation over the same lattices: tasks count their distinct words, shards of the hash space add the
counts up, and every round sums the pieces' expected uses over all distinct training words, weighted by their counts.
No piece is made or dropped. Uses are summed as whole numbers of 2**-16, so that every run learns the same scores.

Scoring deals the documents into buckets once; a bucket asks the shards for its distinct words, and gets a word's count
and log probability back. A word is thereby worked through once, however many documents hold it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bucketed, checkpoint, document_schema, trim, with_rest
from tidemark.llm.lattice import Lattice, Pieces, pieces
from tidemark.llm.shards import ANSWER, MESSAGE, answer_table, message_table, messages, planes, shard_bounds, unplanes
from tidemark.llm.text import Slice, hasher, laid_out, text_column

U = np.uint64
SEED = 1307
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Rounds of expectation maximisation; what every piece has been used besides; the unit of summed uses.
ROUNDS, SMOOTHING, UNIT = 4, 0.01, 1 << 16
#: Bytes of words whose lattices are held at once.
LATTICE_BYTES = 1 << 18
HEAD = 8  # first ranks are taken as nearly equally frequent before the first round
WORDS = "shard int, tokens long, distinct long, payload binary"


def training(doc_id: Column) -> Column:
    """Whether a document is learned from: crc32 of the doc_id's decimal text does not leave 2 when divided by 7."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(True))


def _hashes(s: Slice) -> np.ndarray:
    return hasher(SEED, lower=True).ranges(s.data, s.starts, s.ends)


def _copied(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """data[start:start + size] one after another."""
    at = np.cumsum(sizes)
    return data[np.arange(at[-1] if len(at) else 0) + np.repeat(starts - (at - sizes), sizes)]


#: Hashes, training counts, bytes, starts and ends of some words; at an end stands one more byte, no part of the word.
Part = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Words:
    """Distinct words by hash, their bytes (each ended by a newline) and training counts."""

    def __init__(self):
        self.hashes = np.zeros(0, U)
        self.counts = np.zeros(0, np.int64)
        self.data = np.zeros(0, np.uint8)
        self.sizes = np.zeros(0, np.int64)

    def add(self, parts: list[Part]) -> Words:
        """These and more words."""
        at = np.cumsum(self.sizes)
        parts = [(self.hashes, self.counts, self.data, at - self.sizes, at - 1), *parts]
        moved = np.cumsum([0, *(len(p[2]) for p in parts[:-1])])
        hashes, counts, data = (np.concatenate([p[i] for p in parts]) for i in range(3))
        starts, ends = (np.concatenate([p[i] + m for p, m in zip(parts, moved, strict=True)]) for i in (3, 4))
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]][: len(ranked)])
        out, one = Words(), order[first]
        if len(one):
            out.hashes, out.counts, out.sizes = ranked[first], np.add.reduceat(counts[order], first), ends[one] - starts[one] + 1
            out.data = _copied(data, starts[one], out.sizes)
            out.data[np.cumsum(out.sizes) - 1] = 10
        return out

    def packed(self, s: slice) -> bytes:
        edges = np.r_[0, np.cumsum(self.sizes)]
        return (s.stop - s.start).to_bytes(8, "little") + zlib.compress(self.data[edges[s.start] : edges[s.stop]].tobytes() + planes(self.counts[s].astype(U), 6), 1)

    @staticmethod
    def unpacked(payload: bytes) -> Part:
        n, raw = int.from_bytes(payload[:8], "little"), zlib.decompress(payload[8:])
        data = np.frombuffer(raw, np.uint8, len(raw) - 6 * n)
        ends = np.flatnonzero(data == 10)
        starts = np.r_[0, ends[:-1] + 1][:n]
        return hasher(SEED, lower=True).ranges(data, starts, ends), unplanes(raw[len(data) :], n, 6).astype(np.int64), data, starts, ends

    def slices(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Some of the words by length, a space before each: their places, bytes and begins."""
        begin = np.cumsum(self.sizes) - self.sizes
        order = which[np.argsort(self.sizes[which], kind="stable")]
        total = np.cumsum(self.sizes[order])
        lo = 0
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + LATTICE_BYTES, "right")))
            own = order[lo:hi]
            begins = np.r_[0, np.cumsum(self.sizes[own])]
            data = np.empty(begins[-1], np.uint8)
            data[begins[:-1]] = 32
            rest = np.ones(len(data), bool)
            rest[begins[:-1]] = False
            data[rest] = _copied(self.data, begin[own], self.sizes[own] - 1)
            yield own, data, begins
            lo = hi


def _counted(batches: Iterable[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """(text, learned) in, MESSAGE out: a task's distinct words and their training counts, by shard."""
    trim()
    words, parts, held = Words(), [], 0
    for batch in batches:
        learned = batch["learned"].to_numpy(zero_copy_only=False).astype(np.int64)
        for s in laid_out(text_column(batch["text"])):
            if len(s.starts):
                own = Words().add([(_hashes(s), learned[s.first + s.doc], LOWER[s.data], s.starts, s.ends)])
                at = np.cumsum(own.sizes)
                parts.append((own.hashes, own.counts, own.data, at - own.sizes, at - 1))
                held += len(own.data)
                if held > max(16 << 20, len(words.data)):
                    words, parts, held = words.add(parts), [], 0
    words = words.add(parts)
    yield from message_table([*messages(0, words.hashes, shards, words.packed)]).to_batches()


def _shard_words(received: pa.Table) -> pa.Table:
    """One shard's distinct words, sorted by hash."""
    trim()
    words = Words().add([Words.unpacked(p) for p in received["payload"].to_pylist()])
    return pa.table({"shard": received["shard"].slice(0, 1), "tokens": pa.array([int(words.counts.sum())], pa.int64()), "distinct": pa.array([int((words.counts > 0).sum())], pa.int64()), "payload": pa.array([words.packed(slice(0, len(words.hashes)))], pa.binary())})


def _uses(batches: Iterable[pa.RecordBatch], found: Pieces, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
    """WORDS in, (piece, uses) out: expected uses of the pieces in the shards' training tokens."""
    total = np.zeros(found.count)
    for batch in batches:
        for payload in batch["payload"].to_pylist():
            trim()
            words = Words().add([Words.unpacked(payload)])
            for own, data, begins in words.slices(np.flatnonzero(words.counts)):
                total += Lattice.of(found, data, begins).expected(scores, words.counts[own], found.count)
    whole = np.rint(total * UNIT).astype(np.int64)
    used = np.flatnonzero(whole)
    yield pa.record_batch([pa.array(used, pa.int32()), pa.array(whole[used])], ["piece", "uses"])


def _log_probabilities(words: Words, found: Pieces, scores: np.ndarray) -> np.ndarray:
    """log10 of the words' probabilities."""
    out = np.zeros(len(words.hashes))
    for own, data, begins in words.slices(np.arange(len(words.hashes))):
        lattice = Lattice.of(found, data, begins)
        out[own] = lattice.totals(lattice.forward(scores)) / math.log(10)
    return out


def first_scores(count: int) -> np.ndarray:
    """log probabilities of `count` pieces and the end, before anything is learned: by rank, the end like the first piece."""
    weight = 1 / (HEAD + np.r_[np.arange(count), 0])
    return np.log(weight / weight.sum())


def learned_scores(words: DataFrame, path: str, ends: int, rounds: int = ROUNDS) -> np.ndarray:
    """log probabilities of the pieces of the vocabulary file and, last, of the end, learned from WORDS and the number of
    training documents. Only as many numbers as there are pieces come to the driver; without training tokens the first
    scores stay."""
    count = pieces(path).count
    scores = first_scores(count)
    if not ends:
        return scores
    for _ in range(rounds):

        def uses(batches: Iterable[pa.RecordBatch], scores: np.ndarray = scores[:-1]) -> Iterator[pa.RecordBatch]:
            return _uses(batches, pieces(path), scores)

        summed = words.select("payload").mapInArrow(uses, "piece int, uses long").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        total = np.zeros(count + 1)
        total[summed["piece"].to_numpy()] = summed["uses"].to_numpy() / UNIT
        total[-1] = ends
        scores = np.log((total + SMOOTHING) / (total.sum() + SMOOTHING * len(total)))
    return scores


def score_texts(docs: DataFrame, path: str, *, rounds: int = ROUNDS) -> DataFrame:
    """The columns of docs and held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are a text's words (A-Z lower-cased) and one end. base_score is the log10 probability under counts of whole
    tokens with one added; n_known counts tokens that training documents hold, train_tokens all of theirs. score is the
    log10 probability under the lattices of the vocabulary file `path` (base64 pieces and ranks; its single bytes give
    every text a segmentation), summed over all segmentations; a word's lattice begins with one space. Null and
    empty texts are an end alone. Rows are documents; those without doc_id are learned from. Columns of docs with the new
    names are replaced. Without training documents N and V are 0, so that every token's base is log10(1), and scores come
    from the ranks. An empty table gives an empty one. Words are known by 64-bit hashes.
    """
    dealt, sizes = bucketed(docs, "rest")
    own = docs.select(F.col("text").cast("string").alias("text"), training(F.col("doc_id").cast("long")).alias("learned"))
    counted = own.mapInArrow(lambda batches: _counted(batches, sizes.shards), MESSAGE)
    words = checkpoint(counted.repartition(sizes.shards, "shard").groupBy("shard").applyInArrow(_shard_words, WORDS))
    ends = own.select("learned").where("learned").count()
    tokens, distinct = words.agg(F.sum("tokens"), F.sum("distinct")).first()
    n, v = (tokens or 0) + ends, (distinct or 0) + (ends > 0)
    scores = learned_scores(words, path, ends, rounds)

    def tokenised(bucket: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bucket's distinct hashes, sorted; each token's place among them; each token's document."""
        trim()
        hashes, places, docs_ = [], [], []
        for s in laid_out(text_column(bucket["text"])):
            own, place = np.unique(_hashes(s), return_inverse=True)
            hashes.append(own)
            places.append(place.astype(np.int32))
            docs_.append((s.first + s.doc).astype(np.int32))
        if not hashes:
            return np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, np.int32)
        own, place = np.unique(np.concatenate(hashes), return_inverse=True)
        edges = np.cumsum([0, *map(len, hashes)])
        return own, np.concatenate([place[lo:][p] for lo, p in zip(edges[:-1], places, strict=True)]), np.concatenate(docs_)

    def ask(bucket: pa.Table) -> pa.Table:
        hashes, _, _ = tokenised(bucket)
        return message_table([*messages(bucket["bucket"][0].as_py(), hashes, sizes.shards, lambda s: planes(hashes[s], 8))])

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        trim()
        known = Words().add([Words.unpacked(p) for p in held["payload"].to_pylist()])
        worth = _log_probabilities(known, pieces(path), scores[:-1])
        out = []
        for bucket, shard, payload in zip(asked["bucket"].to_pylist(), asked["shard"].to_pylist(), asked["payload"].to_pylist(), strict=True):
            at = np.searchsorted(known.hashes, unplanes(payload, len(payload) // 8, 8))
            out.append((bucket, shard, planes(known.counts[at].astype(U), 6) + worth[at].astype("<f8").tobytes()))
        return answer_table(out)

    def score(bucket: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, place, doc = tokenised(bucket)
        by = dict(zip(answers["shard"].to_pylist(), answers["payload"].to_pylist(), strict=True))
        bounds = shard_bounds(hashes, sizes.shards)
        count, worth = np.zeros(len(hashes), np.int64), np.zeros(len(hashes))
        for s in np.flatnonzero(np.diff(bounds)):
            k, payload = int(bounds[s + 1] - bounds[s]), by[int(s)]
            count[bounds[s] : bounds[s + 1]] = unplanes(payload, k, 6)
            worth[bounds[s] : bounds[s + 1]] = np.frombuffer(payload, "<f8", k, 6 * k)
        rows = bucket.num_rows

        def summed(x: np.ndarray) -> np.ndarray:
            return np.bincount(doc, x[place], rows)

        base = np.log10(count + 1.0) - math.log10(n + v + 1)
        end = math.log10(ends + 1.0) - math.log10(n + v + 1)
        new = {
            "n_tokens": np.bincount(doc, minlength=rows) + 1,
            "n_known": summed(count > 0).astype(np.int64) + (ends > 0),
            "base_score": summed(base) + end,
            "score": summed(worth) + scores[-1] / math.log(10),
        }
        return pa.table({"doc_id": bucket["doc_id"], "text": bucket["text"].cast(pa.string()), "rest": bucket["rest"]} | {c: pa.array(x) for c, x in new.items()})

    asked = dealt.groupBy("bucket").applyInArrow(ask, MESSAGE)
    answers = asked.groupBy("shard").cogroup(words.select("shard", "payload").groupBy("shard")).applyInArrow(answer, ANSWER)
    scored = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score, document_schema(dealt, "n_tokens long, n_known long, base_score double, score double"))
    scored = scored.withColumn("held_out", ~training(F.col("doc_id"))).withColumn("train_tokens", F.lit(n).cast("long"))
    return with_rest(scored, docs, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
