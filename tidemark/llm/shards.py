"""Two-way exchange between buckets of documents and shards of the hash space.

A bucket sends each shard one message: the sorted distinct hashes that it holds of the shard's range, as byte planes,
with a number for each. A shard combines the messages of all buckets by whole-array operations and answers each with
one value per entry. Hot hashes are thereby aggregated before they move: a bucket sends any hash once, however many of
its documents hold it, and shards divide the hash space evenly. There are far fewer shards than buckets; sizes of both
grow with the input (common.layout), so that the number of messages grows in proportion to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MESSAGE = "shard int, bucket int, payload binary"
ANSWER = "bucket int, shard int, payload binary"


def planes(x: np.ndarray, count: int) -> bytes:
    """The `count` low bytes of unsigned 64-bit numbers, byte by byte; slowly changing bytes compress well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :count].T.tobytes()


def unplanes(data: bytes | memoryview, n: int, count: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :count] = np.frombuffer(data, np.uint8, n * count).reshape(count, n).T
    return out.reshape(-1).view("<u8")


def shard_bounds(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range begins in sorted hashes, and the end."""
    edges = np.array([-(-(i << 64) // shards) for i in range(1, shards)], U)
    return np.r_[0, np.searchsorted(hashes, edges), len(hashes)]


def messages(bucket: int, hashes: np.ndarray, shards: int, encode: Callable[[slice], bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(shard, bucket, payload) for each shard that has some of the sorted hashes."""
    bounds = shard_bounds(hashes, shards)
    for s in np.flatnonzero(np.diff(bounds)):
        yield int(s), bucket, encode(slice(int(bounds[s]), int(bounds[s + 1])))


def table(rows: list[tuple[int, int, bytes]], names: tuple[str, str]) -> pa.Table:
    a, b, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({names[0]: pa.array(a, pa.int32()), names[1]: pa.array(b, pa.int32()), "payload": pa.array(payload, pa.binary())})


def message_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return table(rows, ("shard", "bucket"))


def answer_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return table(rows, ("bucket", "shard"))


# counts: how many documents hold each hash

HASH_BYTES = 6


def count_messages(bucket: int, hashes: np.ndarray, documents: np.ndarray, shards: int) -> Iterator[tuple[int, int, bytes]]:
    """For sorted hashes and the number of the bucket's documents with each. 48 bits of a hash are sent: two different
    hashes that agree in them count as one, so that counts are upper bounds. A bucket's number is sent up to 255 and a
    total's logarithm answered up to 15: they order hashes and tell one holder from several, no more."""
    local = np.minimum(documents, 255).astype(np.uint8)
    return messages(bucket, hashes, shards, lambda s: planes(hashes[s] >> U(64 - 8 * HASH_BYTES), HASH_BYTES) + local[s].tobytes())


def count_answers(received: pa.Table) -> pa.Table:
    """A shard's work: answers each entry with floor(log2(documents that hold the hash)), 0 to 15; bucket < 0: passed on."""
    buckets, payloads = received["bucket"].to_pylist(), received["payload"].to_pylist()
    shard = received["shard"][0].as_py()
    sizes = [len(p) // (HASH_BYTES + 1) for p in payloads]
    hashes = np.concatenate([unplanes(p, n, HASH_BYTES) for p, n in zip(payloads, sizes, strict=True)])
    local = np.concatenate([np.frombuffer(p, np.uint8, n, n * HASH_BYTES) for p, n in zip(payloads, sizes, strict=True)])
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    total = np.add.reduceat(local[order].astype(np.int64), np.flatnonzero(new))
    kind = np.empty(len(hashes), np.uint8)
    kind[order] = np.minimum(np.log2(total).astype(np.uint8), 15)[np.cumsum(new) - 1]
    out, at = [], 0
    for b, n in zip(buckets, sizes, strict=True):
        out.append((b, shard, zlib.compress(kind[at : at + n].tobytes(), 1)))
        at += n
    return answer_table(out)



def count_classes(answers: pa.Table, hashes: np.ndarray, shards: int) -> np.ndarray:
    """The answers for the bucket's sorted hashes, as they were sent."""
    by = dict(zip(answers["shard"].to_pylist(), answers["payload"].to_pylist(), strict=True))
    bounds = shard_bounds(hashes, shards)
    out = np.zeros(len(hashes), np.uint8)
    for s in np.flatnonzero(np.diff(bounds)):
        out[bounds[s] : bounds[s + 1]] = np.frombuffer(zlib.decompress(by[int(s)]), np.uint8)
    return out
