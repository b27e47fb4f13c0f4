"""A corpus pipeline of five stages over `documents`: each works on all that its predecessor kept.

Counted as part of tidemark.llm. A stage takes (spark, docs, sf_dir); its result is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents, others that docs has among them. Every stage
first returns what the driver has freed to the system, takes an empty table and gives an empty one; null texts count as empty, rows without doc_id as documents of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint_folder
from tidemark.llm.jaccard import grouped
from tidemark.llm.labelled import give_back
from tidemark.llm.linededup import dedup_lines
from tidemark.llm.packing import packed_documents
from tidemark.llm.queries import vocabulary
from tidemark.llm.substring import remove_repeats
from tidemark.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Labels are those of the labels table.

    Equal texts are kept or rejected alike, also in repeated rows; null texts stay, and null stays null.
    """
    give_back()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels).where("predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars counts what is left.

    A null text becomes an empty one. Rows of one doc_id are one document; of rows without doc_id all are earlier than
    any document with one.
    """
    give_back()
    return _measured(dedup_lines(docs), docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: one with the smallest doc_id. Rows without doc_id or words stay.

    Of repeated rows of one doc_id and text one stays; rows of one doc_id with different texts are told apart.
    """
    give_back()
    docs_ = docs.withColumn("_text", F.xxhash64("text"))
    rows = grouped(docs).withColumnRenamed("text_hash", "_text").where("doc_id is not null and component is not null").groupBy("component", "doc_id", "_text").agg(F.count(F.lit(1)).alias("_n"))
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "_text")).alias("_first"))
    rows = rows.join(first, "component").withColumn("_kept", F.col("_first") == F.struct("doc_id", "_text"))
    change = rows.where("not _kept or _n > 1").select("doc_id", "_text", "_kept")
    key = ["doc_id", "_text"]
    repeated = docs_.join(change.where("_kept"), key, "left_semi").dropDuplicates(key)
    return docs_.join(change, key, "left_anti").unionByName(repeated).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that begin in an earlier document; n_chars counts what is left.

    Words are joined by single spaces; a null text becomes an empty one. Repeated rows of one doc_id do not cut each
    other; rows without doc_id are later than all documents with one.
    """
    give_back()
    return _measured(remove_repeats(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2,048 tokens. Null and empty texts, repeated rows and
    rows without doc_id have pieces like others."""
    give_back()
    return packed_documents(docs, vocabulary("word_bpe_49k.json"))


def _measured(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*docs.columns).withColumn("n_chars", F.length("text").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: No SQL: the first stage is a trained model and the last a bin packing; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again; what a stage has read is removed
    when its own result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
