"""Bounded samples of labelled documents, and letter tokens of texts."""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import trim
from tidemark.llm.text import Slice

U = np.uint64
#: Bytes of letters: A-Z, a-z and all of non-ASCII characters.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id's decimal text leaves 2 when divided by 4; false without doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, label: Column, sizes: dict[int, int]) -> tuple[DataFrame, dict[int, float]]:
    """(text, label, weight) of at most sizes[label] labelled documents of each label, none of them held out, and the
    labels' numbers of documents. Of a label with more, those with the smallest hash of doc_id are taken, and weight
    makes up for the rest. A doc_id with several labels counts with the largest, one with several texts (repeated rows)
    with the smallest."""
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", label.cast("int").alias("label")).where(F.col("label").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect() if r["label"] in sizes}
    parts = None
    for value, size in sizes.items():
        if totals.get(value):
            weight = max(totals[value] / size, 1.0)
            part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).withColumn("weight", F.lit(weight))
            parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return docs.select("text", F.lit(0).alias("label"), F.lit(1.0).alias("weight")).where(F.lit(False)), totals
    # at most sum(sizes) ids: small enough to send to every executor
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(parts), "doc_id")
    return own.groupBy("doc_id", "label", "weight").agg(F.min("text").alias("text")).select("text", "label", "weight"), totals


def letter_runs(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters in a slice's bytes, and each run's document."""
    edge = np.flatnonzero(np.diff(LETTER[s.data], prepend=False))
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, np.searchsorted(s.begins, starts, "right") - 1


def give_back() -> None:
    """Returns memory that training has freed to the system."""
    gc.collect()
    trim()
