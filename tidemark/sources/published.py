"""Versioned tables: written aside, audited, then published by one pointer that readers pin.

A table's folder holds data/<version>/... and pointers/<number>. A pointer is a small file that is written under another
name and renamed, and is never changed: the one of the largest number is in force. A version that was not published, for
whatever reason, is never seen; a reader that has pinned a pointer keeps its rows while newer ones are published.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import duplicates, violations


class Refused(RuntimeError):
    """A version broke its checks; `counts` says how often each."""

    def __init__(self, counts: Mapping[str, int]):
        super().__init__(", ".join(f"{k}: {n}" for k, n in counts.items()))
        self.counts = dict(counts)


class Unfinished(RuntimeError):
    """A run has not collected all that it planned."""


@dataclass(frozen=True)
class Pointer:
    number: int
    version: str
    #: The folder of each part of the table, below data/.
    parts: dict[str, str] = field(default_factory=dict)
    #: What the publisher keeps with the pointer (a stream's last batch).
    note: dict[str, int] = field(default_factory=dict)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> Pointer | None:
    """The pointer in force; none for a table that was never published."""
    folder, store = _place(spark, f"{path}/pointers")
    if not store.exists(folder):
        return None
    names = [s.getPath().getName() for s in store.listStatus(folder)]
    numbers = [int(n) for n in names if n.isdigit()]
    if not numbers:
        return None
    text = spark.read.text(f"{path}/pointers/{max(numbers):012d}", wholetext=True).first()[0]
    return Pointer(**json.loads(text))


def point(spark: SparkSession, path: str, before: Pointer | None, version: str, parts: Mapping[str, str], note: Mapping[str, int] | None = None) -> Pointer:
    """Publishes: from here on readers see the parts. Of two publishers that started from one pointer the second fails."""
    new = Pointer(before.number + 1 if before else 1, version, dict(parts), dict(note or {}))
    final, store = _place(spark, f"{path}/pointers/{new.number:012d}")
    hidden, _ = _place(spark, f"{path}/pointers/_{new.number:012d}.{version}")
    stream = store.create(hidden, True)
    stream.write(bytearray(json.dumps(new.__dict__).encode()))
    stream.close()
    # a rename fails where the name is taken, so that numbers are given once
    if store.exists(final) or not store.rename(hidden, final):
        store.delete(hidden, False)
        raise RuntimeError(f"{path}: pointer {new.number} was published by another")
    return new


def rows_of(spark: SparkSession, path: str, pointer: Pointer | None = None, *, kind: str = "rows") -> DataFrame | None:
    """The rows (or the withdrawals) that a pointer, or else the one in force, names; none before the first."""
    pointer = pointer or current(spark, path)
    folders = sorted({f"{path}/data/{p}/{kind}" for p in pointer.parts.values()}) if pointer else []
    return spark.read.parquet(*folders) if folders else None


def audit(rows: DataFrame, keys: Sequence[str], checks: Mapping[str, Column]) -> dict[str, int]:
    """How many rows break each check, and how many keys are not there exactly once; only what is broken is named."""
    named = {**checks, **{f"{k} is null": F.col(k).isNotNull() for k in keys}}
    counts = violations(rows, named).first().asDict()
    counts["repeated keys"] = duplicates(rows, keys).count()
    return {k: n for k, n in counts.items() if n}


def withdrawn(old: DataFrame | None, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """(keys, version): keys that the version no longer has."""
    before = new.where(F.lit(False)) if old is None else old
    return before.select(*keys).distinct().join(new.select(*keys), list(keys), "left_anti").withColumn("version", F.lit(version))


def finished(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(planned, done, missing, marked): one row; marked only if something was planned and every unit is done."""
    own = planned.select(*keys).distinct().join(done.select(*keys).distinct().withColumn("_done", F.lit(1)), list(keys), "left")
    out = own.agg(F.count(F.lit(1)).alias("planned"), F.count("_done").alias("done"))
    return out.withColumn("missing", F.col("planned") - F.col("done")).withColumn("marked", (F.col("planned") > 0) & (F.col("missing") == 0))


def publish(rows: DataFrame, path: str, version: str, *, keys: Sequence[str], checks: Mapping[str, Column] | None = None, run: DataFrame | None = None) -> Pointer:
    """Writes rows aside as a version, audits what was written, lists withdrawals and publishes.

    run is the row of `finished`; an unfinished run is refused before anything is written. A version that breaks a check
    raises Refused. Whatever fails, the version in force stays; a version can be tried again under its name.
    """
    spark = rows.sparkSession
    if run is not None and not run.first()["marked"]:
        raise Unfinished(f"{version}: the run is not finished")
    before = current(spark, path)
    if before and before.version == version:
        raise ValueError(f"{version} is in force already")
    rows.write.mode("overwrite").parquet(f"{path}/data/{version}/rows")
    staged = spark.read.schema(rows.schema).parquet(f"{path}/data/{version}/rows")
    broken = audit(staged, keys, checks or {})
    if broken:
        raise Refused(broken)
    withdrawn(rows_of(spark, path, before) if before else None, staged, keys, version).write.mode("overwrite").parquet(f"{path}/data/{version}/withdrawn")
    return point(spark, path, before, version, {"all": version})


def upsert_latest(batch: DataFrame, number: int, path: str, *, keys: Sequence[str], newest: str, buckets: int = 64) -> Pointer | None:
    """One batch of a stream into a table that keeps, for each key, the row of the largest `newest` (ties: the larger row).

    Keys are dealt into buckets; only buckets that the batch touches are written anew, aside, and the pointer then names
    them. A batch that is repeated after a restart is recognised by its number and changes nothing.
    """
    spark = batch.sparkSession
    before = current(spark, path)
    if before and number <= before.note["batch"]:
        return before
    columns = batch.columns
    dealt = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    # at most `buckets` numbers
    touched = [r[0] for r in dealt.select("_bucket").distinct().collect()]
    if not touched:
        return before
    held = dict(before.parts) if before else {}
    folders = [f"{path}/data/{held[str(b)]}/rows" for b in touched if str(b) in held]
    if folders:
        dealt = dealt.unionByName(spark.read.parquet(*folders).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    order = [F.col(newest).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in columns if c not in keys and c != newest)]
    last = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_bucket", *keys).orderBy(*order))).where("_place = 1").drop("_place")
    version = f"batch-{number}"
    last.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/written/{version}")
    for b in touched:
        source, store = _place(spark, f"{path}/written/{version}/_bucket={b}")
        target, _ = _place(spark, f"{path}/data/{version}/{b}/rows")
        if store.exists(target):  # of a try that did not come to its end
            store.delete(target, True)
        store.mkdirs(target.getParent())
        store.rename(source, target)
    return point(spark, path, before, version, {**held, **{str(b): f"{version}/{b}" for b in touched}}, {"batch": number})
