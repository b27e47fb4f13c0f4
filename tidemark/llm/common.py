"""What the operators share: parallelism, checkpoints, and how documents are carried through Arrow."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text of a bucket (loaded whole by one task) and of the texts whose hashes a shard takes, at most. Both grow
#: with the square root of the input up to here, so that buckets x shards, the messages of a round, grow in proportion
#: to the input; executors with more memory can take more.
BUCKET_BYTES, SHARD_BYTES = 32 << 20, 128 << 20
#: Square of a bucket's bytes over the input's bytes, and how much larger a shard's share is.
GRAIN, SHARD = 32 << 10, 4
#: Documents in a bucket at most, for tables of very short texts; partitions at most, each of several buckets.
BUCKET_ROWS, PARTITIONS = 20_000, 50_000


@dataclass(frozen=True)
class Layout:
    """How many buckets documents are dealt to, partitions that hold them, and shards that divide the hashes."""

    buckets: int
    partitions: int
    shards: int


def layout(size: int, rows: int, cores: int) -> Layout:
    """For a table of so many bytes of text and rows."""
    own = min(max(math.isqrt(size * GRAIN), 1 << 20), BUCKET_BYTES)
    share = min(max(SHARD * math.isqrt(size * GRAIN), 1 << 20), SHARD_BYTES)
    least = min(cores, -(-size // (64 << 10)))  # smaller tables do not need every core
    buckets = max(1, least, -(-size // own), -(-rows // BUCKET_ROWS))
    return Layout(buckets, min(buckets, PARTITIONS), max(1, least, -(-size // share)))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Returns memory that is free to the system, where the C library can. Python workers call it before each bucket,
    as they outlive their tasks and would keep the largest bucket's memory."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """A worker's one large object of its own: made when first asked for, given up when another is."""
    if name not in _KEPT:
        give_up()
        _KEPT[name] = make()
    return _KEPT[name]


def give_up() -> None:
    """Drops what an operator has kept in this worker. Workers outlive their tasks and serve other operators next, whose
    memory would come on top."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    trim()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir, which checkpoints use too.

    Only where none is named and the master is this machine (tests), a temporary folder is set; a cluster without a
    named folder is an error, as its machines do not see each other's.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder and reads it from there, so that its lineage ends."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as a table to a new place in the checkpoint folder and read from there, and the place. Unlike a checkpoint,
    which keeps the plan's estimate, its size is known from the files: estimates of joins that are iterated multiply until
    the driver computes with numbers of millions of digits."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def document_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): rest holds the other columns, whatever their names, as one struct."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(others or [F.lit(0).alias("none")])).alias("rest"))


def with_rest(df: DataFrame, docs: DataFrame, *new: str) -> DataFrame:
    """The columns of docs in their order, taken from df's doc_id, text and rest; then the columns `new` of df."""
    own = [F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns if c not in new]
    return df.select(*own, *new)


def document_schema(rows: DataFrame, new: str) -> StructType:
    """doc_id, text and rest as in rows, then the columns of the DDL text `new`."""
    return StructType([rows.schema[c] for c in ("doc_id", "text", "rest")] + StructType.fromDDL(new).fields)


def bucketed(docs: DataFrame, *columns: str) -> tuple[DataFrame, Layout]:
    """Documents dealt by doc_id into buckets, and their layout.

    Rows of one doc_id share a bucket; rows without doc_id are dealt by their text and input partition, so that many
    equal ones spread. Plans use the result several times; Spark then reads the same shuffle files again (exchange
    reuse), so that texts are moved once.
    """
    spark = docs.sparkSession
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col("text").cast("string")))).first()
    sizes = layout(size or 0, rows, parallelism(spark))
    own = document_rows(docs).select("doc_id", "text", *columns)
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.coalesce("text", F.lit("")), F.spark_partition_id())).otherwise(F.xxhash64("doc_id"))
    return own.withColumn("bucket", F.pmod(key, F.lit(sizes.buckets)).cast("int")).repartition(sizes.partitions, "bucket"), sizes
