"""Substring dedup: words in passages that begin in an earlier document go.

A window is `window` consecutive words. Anchors are hashes of the words from positions that lie, modulo a period, in a
difference cover: for any two positions there is a shift below the period that brings both into the cover, so that two
equal windows share an anchor of window - period + 1 words at a shift that both hash. First, buckets learn which of
their anchors more than one document holds (shards.py); then only windows with such an anchor are extended, that is
hashed in full (80 bits), and shards answer whether an earlier document holds them.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import bucketed, document_schema, trim, with_rest
from tidemark.llm.shards import ANSWER, MESSAGE, answer_table, count_answers, count_classes, count_messages, message_table, messages, planes, shard_bounds, unplanes
from tidemark.llm.text import Hasher, Slice, hasher, laid_out, text_column

U = np.uint64
#: Fixed value: a difference cover of the period 7; 1 - 0, 3 - 1, 3 - 0 and their negatives give all differences.
PERIOD, COVER = 7, (0, 1, 3)
FIRST, SECOND = 71, 72  # seeds of the hashes
WIDTH = 10 + 8  # bytes of an entry: 80 bits of hash, 64 of doc_id
#: Stands for a missing doc_id: never smaller than another.
NO_ID = (1 << 63) - 1


def anchors(words: np.ndarray, s: Slice, own: Hasher, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a document's own anchors begin, and their hashes."""
    at = np.arange(max(len(words) - length + 1, 0))
    if not len(at):
        return at, words[:0]
    doc = s.doc
    place = at - s.bounds[doc[at]]
    fits = np.isin(place % PERIOD, COVER) & (doc[at] == doc[at + length - 1])
    return at[fits], own.grams(words, length)[fits]


def distinct(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and the number of different documents with each."""
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    new = np.r_[True, h[1:] != h[:-1]][: len(h)]
    pair = new | np.r_[True, d[1:] != d[:-1]][: len(h)]
    at = np.flatnonzero(new)
    return h[at], np.add.reduceat(pair.astype(np.int64), at) if len(at) else at


def _doc_keys(bucket: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each row its doc_id (NO_ID if null) and a number that rows of one doc_id share."""
    ids = bucket["doc_id"].fill_null(NO_ID).to_numpy()
    own = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    return ids, np.where(bucket["doc_id"].is_null().to_numpy(zero_copy_only=False), len(ids) + np.arange(len(ids)), own)


class Windows:
    """The windows of a bucket's documents that have a shared anchor."""

    def __init__(self, bucket: pa.Table, answers: pa.Table, shards: int, window: int):
        ids, _ = _doc_keys(bucket)
        length = window - PERIOD + 1
        first, second = hasher(FIRST), hasher(SECOND)
        self.slices: list[tuple[Slice, np.ndarray]] = []
        found: list[tuple[Slice, np.ndarray, np.ndarray, np.ndarray]] = []
        for s in laid_out(text_column(bucket["text"])):
            words = first.ranges(s.data, s.starts, s.ends)
            found.append((s, *anchors(words, s, first, length), words))
        all_hashes = np.concatenate([f[2] for f in found]) if found else np.zeros(0, U)
        known = np.unique(all_hashes)
        shared = count_classes(answers, known, shards) > 0
        one, two, doc_ids = [], [], []
        for s, at, hashes, words in found:
            hit = at[shared[np.searchsorted(known, hashes)]]
            # windows from hit - (PERIOD - 1) to hit contain the anchor
            n = max(len(words) - window + 1, 0)
            edge = np.zeros(n + PERIOD + 1, np.int64)
            np.add.at(edge, np.maximum(hit - PERIOD + 1, 0)[hit - PERIOD + 1 < n], 1)
            np.add.at(edge, (hit + 1)[hit - PERIOD + 1 < n].clip(max=n), -1)
            begin = np.flatnonzero(np.cumsum(edge)[:n] > 0)
            doc = s.doc
            begin = begin[doc[begin] == doc[begin + window - 1]] if len(begin) else begin
            self.slices.append((s, begin))
            if len(begin):
                one.append(first.grams(words, window)[begin])
                two.append(second.grams(second.ranges(s.data, s.starts, s.ends), window)[begin] >> U(48))
                doc_ids.append(ids[s.first + doc[begin]])
        none = np.zeros(0, U)
        self.one, self.two = np.concatenate(one or [none]), np.concatenate(two or [none])
        self.doc = np.concatenate(doc_ids or [none.astype(np.int64)])
        order = np.lexsort((self.two, self.one))
        a, b = self.one[order], self.two[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        starts = np.flatnonzero(new)
        #: Distinct windows in order, the smallest doc_id of the bucket with each, and each window's place among them.
        self.a, self.b = a[starts], b[starts]
        self.least = np.minimum.reduceat(self.doc[order], starts) if len(starts) else self.doc
        self.place = np.empty(len(a), np.int64)
        self.place[order] = np.cumsum(new) - 1


def remove_repeats(docs: DataFrame, *, window: int = 13) -> DataFrame:
    """The columns of docs with text (the words kept, joined by spaces), and n_words, n_removed and kept_sha256.

    A word (a run of characters other than 0x20 and 0x09 to 0x0D) goes if a window that covers it also begins in a
    document with a smaller doc_id; windows are those of the input. Null and empty texts have no words and stay empty.
    Equal doc_ids (repeated rows) do not remove each other's words; rows without doc_id count as later than all
    others and not as earlier than each other. Columns of docs with the new names are replaced.
    """
    if window < PERIOD:
        raise ValueError(f"windows of at least {PERIOD} words are expected")
    dealt, sizes = bucketed(docs, "rest")
    n = sizes.shards
    length = window - PERIOD + 1

    def send_anchors(bucket: pa.Table) -> pa.Table:
        trim()
        first = hasher(FIRST)
        _, own = _doc_keys(bucket)
        hashes, holders = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for s in laid_out(text_column(bucket["text"])):
            at, h = anchors(first.ranges(s.data, s.starts, s.ends), s, first, length)
            hashes.append(h)
            holders.append(own[s.first + s.doc[at]])
        return message_table([*count_messages(bucket["bucket"][0].as_py(), *distinct(np.concatenate(hashes), np.concatenate(holders)), n)])

    def send_windows(bucket: pa.Table, answers: pa.Table) -> pa.Table:
        trim()
        number = bucket["bucket"][0].as_py()
        w = Windows(bucket, answers, n, window)
        sent = [*messages(number, w.a, n, lambda s: planes(w.a[s], 8) + planes(w.b[s], 2) + planes(w.least[s].view(U), 8))]
        # the answers on anchors travel along, to the same bucket
        return message_table(sent + [(-1 - s, number, p) for s, p in zip(answers["shard"].to_pylist(), answers["payload"].to_pylist(), strict=True)])

    def earlier(received: pa.Table) -> pa.Table:
        """Bits: whether another bucket has a smaller doc_id for the window."""
        trim()
        shard = received["shard"][0].as_py()
        buckets, payloads = received["bucket"].to_pylist(), received["payload"].to_pylist()
        if shard < 0:
            return answer_table([(b, shard, p) for b, p in zip(buckets, payloads, strict=True)])
        sizes = [len(p) // WIDTH for p in payloads]
        views = [memoryview(p) for p in payloads]
        a = np.concatenate([unplanes(v, k, 8) for v, k in zip(views, sizes, strict=True)])
        b = np.concatenate([unplanes(v[8 * k :], k, 2) for v, k in zip(views, sizes, strict=True)])
        least = np.concatenate([unplanes(v[10 * k :], k, 8) for v, k in zip(views, sizes, strict=True)]).view(np.int64)
        order = np.lexsort((b, a))
        ra, rb = a[order], b[order]
        new = np.r_[True, (ra[1:] != ra[:-1]) | (rb[1:] != rb[:-1])]
        least_of_all = np.empty(len(a), np.int64)
        least_of_all[order] = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        bits, out, at = least_of_all < least, [], 0
        for bucket, k in zip(buckets, sizes, strict=True):
            out.append((bucket, shard, zlib.compress(np.packbits(bits[at : at + k]).tobytes(), 1)))
            at += k
        return answer_table(out)

    def keep(bucket: pa.Table, answers: pa.Table) -> pa.Table:
        trim()
        shard = answers["shard"].to_numpy()
        anchor_answers = pa.table({"shard": pa.array(-1 - shard[shard < 0], pa.int32()), "payload": answers.filter(pa.array(shard < 0))["payload"]})
        w = Windows(bucket, anchor_answers, n, window)
        bounds = shard_bounds(w.a, n)
        by = dict(zip(shard.tolist(), answers["payload"].to_pylist(), strict=True))
        elsewhere = np.zeros(len(w.a), bool)
        for s in np.flatnonzero(np.diff(bounds)):
            lo, hi = int(bounds[s]), int(bounds[s + 1])
            elsewhere[lo:hi] = np.unpackbits(np.frombuffer(zlib.decompress(by[int(s)]), np.uint8), count=hi - lo)
        repeated = elsewhere[w.place] | (w.doc > w.least[w.place])
        texts, words_n, removed_n, sha, at = [], [], [], [], 0
        for s, begin in w.slices:
            hit = begin[repeated[at : at + len(begin)]]
            at += len(begin)
            edge = np.zeros(len(s.starts) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
            stays = np.cumsum(edge)[:-1] == 0
            kept = np.flatnonzero(stays)
            # each kept word with the byte after it, which becomes a space unless it is the document's last
            mark = np.zeros(len(s.data) + 1, np.int8)
            mark[s.starts[kept]] += 1
            mark[s.ends[kept] + 1] -= 1
            inside = np.cumsum(mark[:-1]) > 0
            data = s.data.copy()
            data[s.ends[kept]] = 0x20
            out = data[inside]
            place = np.r_[0, np.cumsum(inside)][s.begins]
            total = np.diff(s.bounds)
            stay_n = np.diff(np.r_[0, np.cumsum(stays)][s.bounds])
            view = out.tobytes()
            for i in range(len(total)):
                text = view[place[i] : max(place[i], place[i + 1] - 1)]
                texts.append(text.decode())
                sha.append(hashlib.sha256(text).hexdigest())
            words_n.append(total)
            removed_n.append(total - stay_n)
        whole = lambda x: pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64))
        return pa.table({"doc_id": bucket["doc_id"], "text": pa.array(texts, pa.string()), "rest": bucket["rest"], "n_words": whole(words_n), "n_removed": whole(removed_n), "kept_sha256": pa.array(sha, pa.string())})

    counted = dealt.groupBy("bucket").applyInArrow(send_anchors, MESSAGE).groupBy("shard").applyInArrow(count_answers, ANSWER)
    sent = dealt.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(send_windows, MESSAGE)
    answered = sent.groupBy("shard").applyInArrow(earlier, ANSWER)
    out = dealt.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(keep, document_schema(dealt, "n_words long, n_removed long, kept_sha256 string"))
    return with_rest(out, docs, "n_words", "n_removed", "kept_sha256")
