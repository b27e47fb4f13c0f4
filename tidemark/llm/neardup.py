"""Near copies among vectors: inverted lists with product-quantised residuals, and exact reranking.

A coarse quantiser and the subspace codebooks are trained on a bounded sample; every vector is indexed. Equal vectors
form a class, which is searched once. A class is listed under its nearest centroid and visits the lists that a vector
within the link's distance could be under: those whose bisecting plane with its own centroid is not farther away. In a
list, distances to the members' codes are sums of table entries (the query itself is not coded); a member is a
candidate if its distance is at most the link's plus the error of its code, which is stored with it. Both bounds are
triangle inequalities, so that no link is missed. Candidates are decided by their cosine in double precision.

Long lists are cut into blocks that meet in pairs. Cells return each vector's number of links and a star for each of
their connected parts, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint
from tidemark.llm.components import components
from tidemark.llm.vectors import matrix, packed, unpacked

#: Vectors that the codebooks are trained on at most, subspaces, codes of each.
SAMPLE, PARTS, CODES = 16_384, 8, 64
#: Lists of each label, at least (given as many vectors to train on) and at most; between, a quarter of the square root
#: of the number of vectors.
LEAST_LISTS, MOST_LISTS = 64, 1024
#: Members or visitors of a block.
BLOCK = 2048
MARGIN = 1e-6


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    random = np.random.default_rng(seed)
    centres = x[random.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = distances(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1), 0)


class Codebooks:
    def __init__(self, sample: np.ndarray, vectors: int):
        n, width = sample.shape
        lists = min(max(math.isqrt(vectors) // 4, LEAST_LISTS), MOST_LISTS)
        self.width = width
        self.part = -(-width // PARTS)
        self.coarse = k_means(sample, max(1, min(lists, n // 16)))
        rest = self._parts(sample - self.coarse[distances(sample, self.coarse).argmin(axis=1)])
        self.books = np.stack([_filled(k_means(rest[:, i], CODES), CODES) for i in range(PARTS)])

    def _parts(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), PARTS * self.part))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), PARTS, self.part)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, subspace codes and the code's error of each vector; squared distances to all centroids."""
        to_lists = distances(x, self.coarse)
        own = to_lists.argmin(axis=1)
        rest = self._parts(x - self.coarse[own])
        codes = np.stack([distances(rest[:, i], self.books[i]).argmin(axis=1) for i in range(PARTS)], axis=1).astype(np.uint8)
        coded = self.books[np.arange(PARTS), codes]
        return own, codes, np.sqrt(((rest - coded) ** 2).sum(axis=(1, 2))), to_lists

    def probes(self, own: np.ndarray, to_lists: np.ndarray, reach: float) -> np.ndarray:
        """Whether a vector within reach could be under a list."""
        between = np.sqrt(distances(self.coarse[own], self.coarse))
        nearest = to_lists[np.arange(len(own)), own][:, None]
        return (to_lists - nearest) <= 2 * (reach + MARGIN) * between + MARGIN

    def tables(self, x: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Squared distances of each vector's parts to every code of one list: (vector, part, code)."""
        rest = self._parts(x - centre)
        return np.stack([distances(rest[:, i], self.books[i]) for i in range(PARTS)], axis=1)


def _filled(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([x, np.repeat(x[:1], k - len(x), axis=0)]) if len(x) < k else x


def near_vectors(vectors: DataFrame, *, least_cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    Vectors of equal labels link if their cosine is at least least_cosine. n_links counts the other rows linked
    directly, component_id is the smallest vec_id that links reach. Null, zero and non-finite vectors, vectors without
    label and rows without vec_id link with nothing (0, their own vec_id, kept). Shorter vectors count as if zeros
    followed. Repeated rows are separate vectors, also those of one vec_id with different vectors; other columns are not kept, whatever their names. An empty table gives an
    empty one.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    reach = math.sqrt(max(2 - 2 * least_cosine, 0))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine, values = matrix(batch.column("embedding"), width or 1)
            largest = np.abs(values).max(axis=1, initial=0)
            some = largest > 0
            fine, values = fine[some], values[some] / largest[some, None]
            values /= np.sqrt((values * values).sum(axis=1))[:, None]
            unit: list[bytes | None] = [None] * batch.num_rows
            keys = np.zeros((batch.num_rows, 2), np.int64)
            for i, data in zip(fine.tolist(), packed(values), strict=True):
                unit[i] = data
                h = xxhash.xxh3_128_digest(data)
                keys[i] = np.frombuffer(h, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(unit, pa.binary()), pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["vec_id", "label", "unit", "h1", "h2"])

    signed = checkpoint(rows.mapInArrow(units, "vec_id long, label string, unit binary, h1 long, h2 long"))
    part = signed.where("unit is not null and label is not null and vec_id is not null")
    key = ["label", "h1", "h2"]
    # a class is known by a hash of its keys, as a vec_id can stand for several
    classes = checkpoint(part.groupBy(*key).agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("weight"), F.min("unit").alias("unit")).withColumn("node", F.xxhash64(*key)))
    sample = classes.select("unit").orderBy(F.xxhash64("unit")).limit(SAMPLE).collect()
    if not sample:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    books = classes.sparkSession.sparkContext.broadcast(Codebooks(np.frombuffer(b"".join(bytes(r[0]) for r in sample), "<f8").reshape(-1, width), classes.count()))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_books = books.value
        for batch in batches:
            x = unpacked(batch.column("unit"), width)
            own, codes, error, to_lists = own_books.code(x)
            probed = own_books.probes(own, to_lists, reach)
            probed &= np.arange(probed.shape[1]) > own[:, None]  # of two lists, the vector of the lower visits the higher
            row, other = np.nonzero(probed)
            at = pa.array(np.r_[np.arange(len(x)), row])
            taken = [batch.column(c).take(at) for c in ("label", "node", "weight", "unit")]
            member = np.r_[np.ones(len(x), bool), np.zeros(len(row), bool)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(np.r_[own, other].astype(np.int32)), pa.array(member), pa.array([c.tobytes() for c in codes], pa.binary()).take(at), pa.array(error).take(at)], ["label", "node", "weight", "unit", "list", "member", "codes", "error"])

    listed = checkpoint(classes.mapInArrow(lists, "label string, node long, weight long, unit binary, list int, member boolean, codes binary, error double"))
    blocks = listed.groupBy("label", "list").agg((F.ceil(F.count_if("member") / BLOCK)).cast("int").alias("mb"), F.ceil(F.count_if(~F.col("member")) / BLOCK).cast("int").alias("vb")).where("mb > 0")
    placed = listed.join(blocks, ["label", "list"])
    own_block = F.pmod(F.xxhash64("node"), F.when(F.col("member"), F.col("mb")).otherwise(F.col("vb"))).cast("int")
    # a member's block meets itself and every other once; a visitor's block meets every block of members
    numbers = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    member_cells = F.concat(
        F.transform(numbers("mb"), lambda j: F.struct(F.lit("m").alias("kind"), F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j"))),
        F.transform(numbers("vb"), lambda v: F.struct(F.lit("v").alias("kind"), v.alias("i"), F.col("block").alias("j"))),
    )
    visitor_cells = F.transform(numbers("mb"), lambda j: F.struct(F.lit("v").alias("kind"), F.col("block").alias("i"), j.alias("j")))
    cells = placed.withColumn("block", own_block).withColumn("cell", F.explode(F.when(F.col("member"), member_cells).otherwise(visitor_cells))).drop("mb", "vb")

    def match(cell: pa.Table) -> pa.Table:
        own_books = books.value
        at = cell["cell"][0].as_py()
        ids, weight, error = (cell[c].to_numpy() for c in ("node", "weight", "error"))
        x, codes = unpacked(cell["unit"], width), np.frombuffer(b"".join(cell["codes"].to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64)
        member, block = cell["member"].to_numpy(zero_copy_only=False), cell["block"].to_numpy()
        if at["kind"] == "v":
            asking, asked = np.flatnonzero(~member), np.flatnonzero(member)
        else:
            asking, asked = np.flatnonzero(block == at["i"]), np.flatnonzero(block == at["j"])
        within = at["kind"] == "m" and at["i"] == at["j"]
        centre = own_books.coarse[cell["list"][0].as_py()]
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for lo in range(0, len(asking), 256):
            some = asking[lo : lo + 256]
            table = own_books.tables(x[some], centre)
            far = np.zeros((len(some), len(asked)))
            for p in range(PARTS):
                far += table[:, p, codes[asked, p]]
            a, b = np.nonzero(np.sqrt(far) <= reach + error[asked] + MARGIN)
            a, b = some[a], asked[b]
            if within:
                a, b = a[a < b], b[a < b]
            for s in range(0, len(a), 1 << 16):
                aa, bb = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                close = np.einsum("ij,ij->i", x[aa], x[bb]) >= least_cosine
                aa, bb = aa[close], bb[close]
                np.add.at(links, aa, weight[bb])
                np.add.at(links, bb, weight[aa])
                for i, j in zip(aa.tolist(), bb.tolist(), strict=True):
                    ri, rj = top(i), top(j)
                    if ri != rj:
                        root[max(ri, rj)] = min(ri, rj)
        roots = np.array([top(i) for i in range(len(ids))], np.int64)
        some = np.flatnonzero(links > 0)
        return pa.table({"a": pa.array(ids[some]), "b": pa.array(ids[roots[some]]), "links": pa.array(links[some])})

    matched = checkpoint(cells.groupBy("label", "list", "cell").applyInArrow(match, "a long, b long, links long"))
    counts = matched.groupBy("a").agg(F.sum("links").alias("links"))
    found = components(matched.select("a", "b"))
    least = found.join(classes, "node").groupBy("component").agg(F.min("class_id").alias("least"))
    grouped = classes.join(counts, F.col("node") == F.col("a"), "left").join(found.join(least, "component"), "node", "left")
    per_class = grouped.select(*key, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("least", "class_id").alias("component"))
    out = signed.withColumn("searched", F.col("unit").isNotNull() & F.col("vec_id").isNotNull()).drop("unit").join(per_class, key, "left")
    own = F.when(F.col("searched"), F.coalesce("component", "vec_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("searched"), F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
