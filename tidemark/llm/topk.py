"""Exact top-k search by exhaustive term-at-a-time accumulation.

Terms are vector components. Queries and candidates meet in the cells of a grid: a candidate is hashed to a column and
goes to all its cells, a query is hashed to a row and goes to all its cells, so that every pair meets in exactly one
cell and a cell's size is bounded whatever the input. A cell turns its candidates into postings (term -> candidates and
weights); each term's sparse query weights scatter the weighted postings into the queries' dense score arrays. A
partition of the scores selects each query's best in the cell; the cells' selections are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import parallelism
from tidemark.llm.vectors import matrix

#: Bytes of a cell's candidates as of its queries, about: vectors are copied once for each cell of their row or column.
CELL_BYTES = 8 << 20
EXACT = 1 << 62


def postings(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term the rows with a weight and the weights."""
    return [(rows := np.flatnonzero(column), column[rows]) for column in values.T]


def accumulate(queries: np.ndarray, terms: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores (query, candidate): term after term, the query rows that hold it scatter its weighted postings."""
    scores = np.zeros((len(queries), n), queries.dtype)
    for (rows, weights), column in zip(terms, queries.T, strict=False):
        own = np.flatnonzero(column)
        if not len(own) or not len(rows):
            continue
        if len(rows) == n:
            if len(own) == len(queries):
                scores += column[:, None] * weights
            else:
                scores[own] += column[own, None] * weights
        else:
            scores[np.ix_(own, rows)] += column[own, None] * weights
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the places of its k best candidates (ties: smaller id first), its own place left out (-1: none)."""
    places = np.arange(len(ids))
    for i, row in enumerate(scores):
        others = places[places != own[i]]
        if len(others) > k:
            best = row[others]
            edge = np.partition(best, len(best) - k)[len(best) - k]
            others = others[best >= edge]
        yield i, others[np.lexsort((ids[others], -row[others]))][:k]


def quantised(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python's where sums of products could exceed them."""
    scaled = np.floor(values * scale)
    largest = float(np.abs(scaled).max(initial=0))
    if largest * largest * scaled.shape[1] >= EXACT:
        return np.array([[int(x) for x in row] for row in scaled], object).reshape(scaled.shape)
    return scaled.astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) from (vec_id, embedding): the k other vectors of highest inner product.

    Components count as floor(scale * x); shorter vectors as if zeros followed. Vectors that are null or hold null or
    non-finite components, and rows without vec_id, take no part. Repeated rows are separate vectors: candidates of each
    other, and queries with a result each. Fewer than k others give fewer ranks. Ties go to the smaller vec_id. Other
    columns are not kept, whatever their names. Scores beyond 64 bits are ranked exactly and returned as the nearest long.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    total, asking, width = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("embedding"))).first()
    side = max(CELL_BYTES // (8 * max(width or 1, 1)), 256)
    columns, lines = max(min(parallelism(spark), -(-total // 256)), -(-total // side), 1), max(1, -(-asking // side))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    offered = rows.select("vec_id", "embedding", F.lit(False).alias("asks"), place(columns).alias("column"), spread(lines).alias("line"))
    asked = rows.where("asks").select("vec_id", "embedding", F.lit(True).alias("asks"), spread(columns).alias("column"), place(lines).alias("line"))
    cells = offered.unionByName(asked).withColumn("cell", F.col("line") * columns + F.col("column")).drop("line", "column")

    def search(cell: pa.Table) -> pa.Table:
        good, values = matrix(cell["embedding"])
        ids, asks = cell["vec_id"].to_numpy()[good], cell["asks"].to_numpy(zero_copy_only=False)[good]
        order = np.lexsort((*values.T[::-1], ids, asks)) if len(ids) else np.zeros(0, np.int64)
        ids, asks, values = ids[order], asks[order], values[order]
        numbers = quantised(values, scale)
        mine, of = ids[asks], values[asks]
        new = np.r_[True, (mine[1:] != mine[:-1]) | (of[1:] != of[:-1]).any(axis=1)][: len(mine)]
        first = np.flatnonzero(new)
        times = np.diff(np.r_[first, len(mine)])  # equal rows ask once and are answered each
        own, asked, whole = mine[first], numbers[asks][first], of[first]
        ids, offered, candidates = ids[~asks], values[~asks], numbers[~asks]
        terms = postings(candidates)
        # a query's own row, or one of those equal to it
        place = np.full(len(own), -1)
        for i, at in enumerate(np.searchsorted(ids, own)):
            while at < len(ids) and ids[at] == own[i] and (offered[at] != whole[i]).any():
                at += 1
            if at < len(ids) and ids[at] == own[i]:
                place[i] = at
        out: list[tuple[int, int, int, int, int]] = []
        low, high = -(1 << 63), (1 << 63) - 1
        for at in range(0, len(own), 256):
            scores = accumulate(asked[at : at + 256], terms, len(ids))
            for i, best in select(scores, ids, place[at : at + 256], k):
                key = xxhash.xxh3_64_intdigest(whole[at + i].tobytes()) - (1 << 63)
                out += [(int(own[at + i]), key, int(times[at + i]), int(ids[j]), min(max(int(scores[i, j]), low), high)) for j in best]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "key", "times", "vec_id", "score"), columns, strict=True)})

    found = cells.groupBy("cell").applyInArrow(search, "query_id long, key long, times long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id"))
    best = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return best.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("query_id", "rank", "vec_id", "score")
