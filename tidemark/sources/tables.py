"""Tables as Parquet with fixed schemas: reading, replacing partitions, checkpoints of units, manifests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.relational import insert_absent

#: Schemas of the raw observations. Others follow from the operators that make them.
SCHEMAS = {
    "posts": "uri string not null, author string not null, created_at timestamp, ingested_at timestamp not null, text string, langs array<string>, rules array<string>",
    "engagement": "uri string not null, polled_at timestamp not null, target_hours int, likes long, reposts long, replies long",
    "cursors": "time_us long not null, written_at timestamp",
    "artist_snapshots": "artist string not null, mbid string, listeners long, playcount long, tags array<string>, fetched_at timestamp not null",
    "releases": "mbid string not null, title string, first_release_date string, credits array<struct<name: string, mbid: string>>, genres array<string>, tags array<struct<name: string, count: int>>, fetched_at timestamp",
    "checkpoints": "source string not null, run_key string not null, phase string not null, unit_key string not null, payload_json string",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, where its machines share files. Only where none is named
    and the master is this machine (tests), a temporary one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="shared-")
    return folder


def settled(df: DataFrame, name: str = "settled") -> tuple[DataFrame, str]:
    """df written to a new place in the shared folder and read from there, and the place: its lineage ends, and its size is
    known from the files (a checkpoint keeps the estimate, which iterated joins multiply)."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Removes a place in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrites the partitions that df has rows of; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: how many rows break each check (a condition that must hold; unknown breaks it)."""
    return df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of more than one row: a primary key's violations."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def checkpoint_units(done: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all units, conflicts): units are written once; one that comes again with another payload is a conflict."""
    keys = ["source", "run_key", "phase", "unit_key"]
    again = new.withColumnRenamed("payload_json", "_new").join(done, keys)
    return insert_absent(done, new, keys), again.where(~F.col("_new").eqNullSafe(F.col("payload_json"))).select(*keys)


def completed_windows(checkpoints: DataFrame) -> DataFrame:
    """(run_key, from, to) of collected date windows whose completion marker is there."""
    windows = checkpoints.where("phase = 'window'").select("run_key", F.expr("try_cast(get_json_object(payload_json, '$.from') as date)").alias("from"), F.expr("try_cast(get_json_object(payload_json, '$.to') as date)").alias("to"))
    finished = checkpoints.where("phase = 'completed'").select("run_key")
    return windows.where("`from` is not null and `to` is not null").join(finished, "run_key", "left_semi")


def full_date(text: Column) -> Column:
    """A date of the shape YYYY-MM-DD; NULL for shorter or impossible ones."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def parsed(raw: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, bad): JSON texts of a schema, and the texts that are none."""
    own = raw.withColumn("_j", F.from_json(column, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_j").isNull() | F.col("_j._corrupt").isNotNull()
    return own.where(~bad).select("_j.*").drop("_corrupt"), own.where(bad).select(column)
