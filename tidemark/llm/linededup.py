"""Line dedup: repeated long lines stay only in the last document that holds them.

Buckets of documents send the hashes of their distinct line keys (128 bits), with the number of documents and the
largest doc_id that hold each, to shards of the hash space. A shard builds a minimal perfect hash over its distinct
line hashes, which indexes arrays of fingerprints, document counts and last owners. Documents then probe these arrays:
a probe is a look-up of seeds, one position, one fingerprint comparison; lines are never joined with lines.
"""

from __future__ import annotations

import hashlib


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidemark.llm.common import bucketed, document_schema, trim, with_rest
from tidemark.llm.shards import answer_table, message_table, messages, planes, unplanes
from tidemark.llm.text import mix, text_column

U = np.uint64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
NO_OWNER = -(1 << 63)


class PerfectHash:
    """A minimal perfect hash by displaced buckets: n keys take the positions 0 to n - 1.

    Keys fall into groups of two on average; the groups, largest first, get the first seed that sends their keys to
    free positions; groups of one key are given free positions directly.
    """

    def __init__(self, seeds: np.ndarray, n: int):
        self.seeds, self.n = seeds, n

    @staticmethod
    def _group(keys: np.ndarray, groups: int) -> np.ndarray:
        return ((keys >> U(32)) * U(groups)) >> U(32)

    @staticmethod
    def _place(keys: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
        return ((mix(keys ^ (seed.astype(U) * U(0x9E3779B97F4A7C15))) >> U(32)) * U(n)) >> U(32)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        groups = max(1, -(-n // 2))
        seeds = np.zeros(groups, np.int64)
        group = cls._group(mix(keys), groups)
        order = np.argsort(group, kind="stable")
        count = np.bincount(group.astype(np.int64), minlength=groups)
        begin = np.cumsum(count) - count
        taken = np.zeros(n, bool)
        for size in np.unique(count[count > 1])[::-1]:
            waiting = np.flatnonzero(count == size)
            members = keys[order[begin[waiting][:, None] + np.arange(size)]]
            seed = 0
            while len(waiting):  # all waiting groups of one size try a seed at once; of those that collide, the first wins
                seed += 1
                if seed > 1 << 20:
                    raise RuntimeError("no perfect hash found")
                at = cls._place(members, np.full(1, seed), n).astype(np.int64)
                ranked = np.sort(at, axis=1)
                candidates = np.flatnonzero(~(taken[at].any(axis=1) | (ranked[:, 1:] == ranked[:, :-1]).any(axis=1)))
                wanted, owner = at[candidates].ravel(), np.repeat(np.arange(len(candidates)), size)
                by_place = np.argsort(wanted, kind="stable")
                later = by_place[1:][wanted[by_place[1:]] == wanted[by_place[:-1]]]
                fine = np.ones(len(candidates), bool)
                fine[owner[later]] = False
                won = candidates[fine]
                taken[at[won].ravel()] = True
                seeds[waiting[won]] = seed
                rest = np.ones(len(waiting), bool)
                rest[won] = False
                waiting, members = waiting[rest], members[rest]
        single = np.flatnonzero(count == 1)
        seeds[single] = -1 - np.flatnonzero(~taken)
        return cls(seeds, n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions; a key that was not among those built from gets some position."""
        seed = self.seeds[self._group(mix(keys), len(self.seeds)).astype(np.int64)]
        return np.where(seed < 0, -1 - seed, self._place(keys, np.maximum(seed, 0), self.n).astype(np.int64))


def _keys(text: bytes, least: int) -> tuple[list[bytes], dict[int, bytes]]:
    """The lines of a text, and the keys of those with at least `least` code points, by line number."""
    lines = text.split(b"\n")
    keys = {}
    for i, line in enumerate(lines):
        if len(line) >= least:
            key = line.strip(b"\t\n\x0b\x0c\r ").translate(LOWER)
            if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                keys[i] = key
    return lines, keys


def _hashes(bucket: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bucket's distinct line keys: two sorted hashes, number of doc_ids and largest doc_id. Null doc_ids count as one each."""
    trim()
    first, second, doc = [], [], []
    for row, (doc_id, text) in enumerate(zip(bucket["doc_id"].to_pylist(), text_column(bucket["text"]), strict=True)):
        for key in set(_keys(text.as_py().encode(), least)[1].values()):
            h = xxhash.xxh3_128_intdigest(key)
            first.append(h >> 64)
            second.append(h & (1 << 64) - 1)
            doc.append((doc_id, row if doc_id is None else 0))
    a, b = np.array(first, U), np.array(second, U)
    ids = np.array([NO_OWNER if d is None else d for d, _ in doc], np.int64)
    rows = np.array([r for _, r in doc], np.int64)
    order = np.lexsort((rows, ids, b, a))
    a, b, ids, rows = a[order], b[order], ids[order], rows[order]
    key = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    own = key | np.r_[True, (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])][: len(a)]
    at = np.flatnonzero(key)
    if not len(at):
        return a, b, ids, ids
    return a[at], b[at], np.add.reduceat(own.astype(np.int64), at), np.maximum.reduceat(ids, at)


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(payload) // 28
    view = memoryview(payload)
    return unplanes(view, n, 8), unplanes(view[8 * n :], n, 8), unplanes(view[16 * n :], n, 4).astype(np.int64), unplanes(view[20 * n :], n, 8).view(np.int64)


def index(sent: DataFrame) -> DataFrame:
    """(shard, n, seeds, fingerprints, counts, owners): each shard's perfect hash over its distinct line hashes and the
    arrays that it indexes, as little-endian numbers."""

    def build(received: pa.Table) -> pa.Table:
        trim()
        a, b, n, last = (np.concatenate(x) for x in zip(*map(_unpack, received["payload"].to_pylist()), strict=True))
        order = np.lexsort((b, a))
        a, b, n, last = a[order], b[order], n[order], last[order]
        at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        keys, check = a[at] ^ mix(b[at]), b[at]
        found = PerfectHash.build(keys)
        place = found.find(keys)
        arrays = [np.zeros(len(at), t) for t in ("<u8", "<u4", "<i8")]
        for array, values in zip(arrays, (check, np.minimum(np.add.reduceat(n, at), 1 << 31), np.maximum.reduceat(last, at)), strict=True):
            array[place] = values
        binary = [pa.array([x.tobytes()], pa.binary()) for x in (found.seeds.astype("<i8"), *arrays)]
        return pa.Table.from_arrays([received["shard"].slice(0, 1).combine_chunks(), pa.array([len(at)], pa.int64()), *binary], ["shard", "n", "seeds", "fingerprints", "counts", "owners"])

    return sent.groupBy("shard").applyInArrow(build, "shard int, n long, seeds binary, fingerprints binary, counts binary, owners binary")


def probe(sent: DataFrame, arrays: DataFrame, least: int) -> DataFrame:
    """(bucket, shard, payload): for each of a bucket's lines that at least `least` documents hold, its two hashes and last owner."""

    def look_up(probes: pa.Table, built: pa.Table) -> pa.Table:
        trim()
        row = built.to_pylist()[0]
        found = PerfectHash(np.frombuffer(row["seeds"], "<i8"), row["n"])
        check, counts, owners = np.frombuffer(row["fingerprints"], "<u8"), np.frombuffer(row["counts"], "<u4"), np.frombuffer(row["owners"], "<i8")
        out = []
        for bucket, payload in zip(probes["bucket"].to_pylist(), probes["payload"].to_pylist(), strict=True):
            a, b, _, _ = _unpack(payload)
            at = found.find(a ^ mix(b))
            hit = (check[at] == b) & (counts[at] >= least)
            if hit.any():
                out.append((bucket, row["shard"], planes(a[hit], 8) + planes(b[hit], 8) + planes(owners[at[hit]].view(U), 8)))
        return answer_table(out)

    return sent.groupBy("shard").cogroup(arrays.groupBy("shard")).applyInArrow(look_up, "bucket int, shard int, payload binary")


def dedup_lines(docs: DataFrame, *, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """The columns of docs with text (the lines kept, joined by newlines), and n_lines, n_dropped and kept_sha256.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased. Keys of at least least_chars code
    points in at least least_docs documents lose all their lines but those in the largest doc_id that holds them. A null
    or empty text is one empty line. Rows with one doc_id are one document for counting and for owning; rows without
    doc_id count as one document each and never own a line that a document with doc_id holds (if none does, all such
    rows keep it). Columns of docs with the new names are replaced; an empty table gives an empty one.
    """
    dealt, sizes = bucketed(docs, "rest")

    def send(bucket: pa.Table) -> pa.Table:
        a, b, count, last = _hashes(bucket, least_chars)
        return message_table([*messages(bucket["bucket"][0].as_py(), a, sizes.shards, lambda s: planes(a[s], 8) + planes(b[s], 8) + planes(count[s].astype(U), 4) + planes(last[s].view(U), 8))])

    def keep(bucket: pa.Table, found: pa.Table) -> pa.Table:
        trim()
        owner: dict[int, int] = {}
        for payload in found["payload"].to_pylist():
            k = len(payload) // 24
            view = memoryview(payload)
            a, b, last = (unplanes(view[8 * i * k :], k, 8) for i in range(3))
            owner.update(((int(x) << 64 | int(y)), int(z)) for x, y, z in zip(a, b, last.view(np.int64), strict=True))
        texts, lines_n, dropped_n, sha = [], [], [], []
        for doc_id, value in zip(bucket["doc_id"].to_pylist(), text_column(bucket["text"]), strict=True):
            text = value.as_py().encode()
            lines, keys = _keys(text, least_chars)
            own = NO_OWNER if doc_id is None else doc_id
            drop = {i for i, key in keys.items() if owner.get(xxhash.xxh3_128_intdigest(key), own) != own} if owner else set()
            kept = b"\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text
            texts.append(kept.decode())
            lines_n.append(len(lines))
            dropped_n.append(len(drop))
            sha.append(hashlib.sha256(kept).hexdigest())
        return pa.table({"doc_id": bucket["doc_id"], "text": pa.array(texts, pa.string()), "rest": bucket["rest"], "n_lines": pa.array(lines_n, pa.int64()), "n_dropped": pa.array(dropped_n, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    sent = dealt.groupBy("bucket").applyInArrow(send, "shard int, bucket int, payload binary")
    found = probe(sent, index(sent), least_docs)
    out = dealt.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(keep, document_schema(dealt, "n_lines long, n_dropped long, kept_sha256 string"))
    return with_rest(out, docs, "n_lines", "n_dropped", "kept_sha256")
