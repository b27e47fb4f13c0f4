"""Streams with state for each key: weekly changes of cumulative counters, and polls that fall due.

Both give what the batch operators give for all that the watermark has passed; events may be late by less than the
delay, come in any order, and come again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.functions import kernels as K

PAIR = "key string, week date, at timestamp, plays long, listeners long, last_at timestamp, last_plays long, last_listeners long"
CLOSED = ["key", "week", "at_us", "plays", "listeners", "last_at_us", "last_plays", "last_listeners"]
HOUR = 3_600_000_000


class WeeklyPairs(StatefulProcessor):
    """Pairs the reading of each closed week of a key with that of the last week before it that had one. Weeks come once, and
    none after a later one. State for a key: one reading, fetched and stored once however many weeks come together."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at_us long, plays long, listeners long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, out = self.last.get() or (None, None, None), []
        for row in sorted(rows, key=lambda r: r["week"]):
            now = (row["at_us"], row["plays"], row["listeners"])
            out.append(Row(**dict(zip(CLOSED, (key[0], row["week"], *now, *before), strict=True))))
            before = now
        self.last.update(before)
        return iter(out)

    def close(self) -> None:
        pass


def weekly_readings(readings: DataFrame, delay: str = "2 days") -> DataFrame:
    """PAIR for a stream of (key, at, plays, listeners): one row for each key and closed week with a reading.

    Spark keeps the latest reading of each open week, by time, then by the counters (NULL is least); only weeks that the
    watermark has passed go on to the state of their key.
    """
    spark: SparkSession = readings.sparkSession
    # values of keys need the store on disk
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = readings.select(F.col("key").cast("string").alias("key"), "at", F.struct("at", "plays", "listeners").alias("r")).withWatermark("at", delay)
    week = F.window("at", "7 days", startTime="4 days")  # the epoch is a Thursday
    latest = own.groupBy("key", week.alias("w")).agg(F.max("r").alias("r"))
    day = F.date_from_unix_date(F.floor(F.unix_seconds("w.start") / 86_400).cast("int"))
    closed = latest.select("key", day.alias("week"), F.unix_micros("r.at").alias("at_us"), "r.plays", "r.listeners")
    kind = "key string, week date, at_us long, plays long, listeners long, last_at_us long, last_plays long, last_listeners long"
    pairs = closed.groupBy("key").transformWithState(WeeklyPairs(), StructType.fromDDL(kind), "Append", "None")
    return pairs.select("key", "week", F.timestamp_micros("at_us").alias("at"), "plays", "listeners", F.timestamp_micros("last_at_us").alias("last_at"), "last_plays", "last_listeners")


def weekly_pairs(readings: DataFrame) -> DataFrame:
    """The batch form of weekly_readings: PAIR for all weeks."""
    week = F.trunc(F.col("at").cast("date"), "week")
    latest = readings.select(F.col("key").cast("string").alias("key"), week.alias("week"), F.struct("at", "plays", "listeners").alias("r")).groupBy("key", "week").agg(F.max("r").alias("r"))
    w = Window.partitionBy("key").orderBy("week")
    return latest.withColumn("b", F.lag("r").over(w)).select("key", "week", "r.*", F.col("b.at").alias("last_at"), F.col("b.plays").alias("last_plays"), F.col("b.listeners").alias("last_listeners"))


def with_status(pairs: DataFrame) -> DataFrame:
    """PAIR with status: how a week's reading relates to the one before. The same for streams and tables."""
    last_week = F.trunc(F.col("last_at").cast("date"), "week")
    status = K.counter_status(F.col("week"), last_week, [F.col("plays"), F.col("listeners")], [F.col("last_plays"), F.col("last_listeners")], at=F.col("at"), last_at=F.col("last_at"))
    return pairs.withColumn("status", status)


def unread(posts: DataFrame, readings: DataFrame, hours: tuple[int, ...] = (24, 72), delay: str = "6 hours", buckets: int = 512) -> DataFrame:
    """(uri, target, due_at): polls of streams posts (uri, created_at) and readings (uri, target, at) that fell due without
    a reading of that target from the post on until then.

    A post waits until both watermarks have passed its last due time, a reading until none that it could meet waits. Posts and
    readings of a bucket of uris share one state, so that a batch costs a call for each bucket, not for each post; memory
    holds one bucket's rows at a time. A checkpoint belongs to its number of buckets. Repeated posts count once, at the
    earliest of their times; repeated readings change nothing.
    """
    uri = posts.schema["uri"].dataType
    own = posts.select("uri", F.lit(0).cast("long").alias("target"), F.col("created_at").alias("at"), F.lit(True).alias("post")).withWatermark("at", delay)
    read = readings.select(F.col("uri").cast(uri).alias("uri"), F.coalesce(F.col("target").cast("long"), F.lit(0)).alias("target"), "at", F.lit(False).alias("post")).withWatermark("at", delay)
    # posts without a uri have a bucket to themselves, where no reading counts
    bucket = F.when(F.col("uri").isNull(), -1).otherwise(F.pmod(F.xxhash64("uri"), F.lit(buckets))).cast("int")
    rows = own.unionByName(read).where("at is not null").select(bucket.alias("bucket"), F.coalesce("uri", F.lit("0").cast(uri)).alias("uri"), "target", "at", F.unix_micros("at").alias("us"), "post")
    kind = StructType.fromDDL("bucket int, target int, due_us long").add("uri", uri)
    due = rows.groupBy("bucket").applyInPandasWithState(_falling_due(hours), kind, "seen_us long, rows binary", "append", GroupStateTimeout.EventTimeTimeout)
    return due.select(F.when(F.col("bucket") >= 0, F.col("uri")).alias("uri"), "target", F.timestamp_micros("due_us").alias("due_at"))


def _falling_due(hours: tuple[int, ...]) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """State for a bucket: the watermark that it has seen, and its rows (uri, target, us, post) that wait, as an Arrow stream."""

    def falling(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        seen, old = state.get if state.exists else (-(2**63), None)
        waiting = [] if old is None else [pa.ipc.open_stream(old).read_pandas()]
        rows = pd.concat([*waiting, *(b[["uri", "target", "us", "post"]] for b in batches)], ignore_index=True)
        post = rows["post"].to_numpy(dtype=bool)
        posts = rows[post].sort_values("us").drop_duplicates("uri")
        read = rows[~post & rows["target"].isin(hours).to_numpy() & (key[0] >= 0)].drop_duplicates()
        target = np.repeat(np.array(hours, dtype=np.int64), len(posts))
        ends = np.tile(posts["us"].to_numpy(), len(hours)) + target * HOUR
        falls = (ends < now) & (ends >= seen)  # what was due before has been given out
        if falls.any():
            due = pd.DataFrame({"bucket": key[0], "uri": np.tile(posts["uri"].to_numpy(), len(hours))[falls], "target": target[falls], "due_us": ends[falls], "n": np.arange(falls.sum())})
            met = due.merge(read[["uri", "target", "us"]], on=["uri", "target"])
            met = met["n"][(met["us"] <= met["due_us"]) & (met["us"] >= met["due_us"] - met["target"] * HOUR)]
            yield due.drop(index=met.unique())[["bucket", "target", "due_us", "uri"]]
        last = read["us"] + read["target"] * HOUR
        kept = pd.concat([posts[posts["us"].to_numpy() + max(hours) * HOUR >= now], read[last >= now]])
        if kept.empty:
            state.remove()
            return
        table = pa.Table.from_pandas(kept, preserve_index=False)
        with pa.BufferOutputStream() as sink:
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            state.update((now, sink.getvalue().to_pybytes()))
        # called again when the watermark has passed the next due time, or the last of readings that no post waits for
        later = ends[ends >= now]
        state.setTimeoutTimestamp(max(int(later.min() if len(later) else last.max()) // 1000, 1))

    return falling


def unread_by(posts: DataFrame, readings: DataFrame, until: Column, hours: tuple[int, ...] = (24, 72)) -> DataFrame:
    """The batch form of unread: polls that were due before `until`."""
    once = posts.groupBy("uri").agg(F.min("created_at").alias("created_at"))
    due = once.select("uri", "created_at", F.explode(F.array(*(F.lit(h) for h in hours))).alias("target")).withColumn("due_at", F.col("created_at") + _hours(F.col("target"))).where(F.col("due_at") < until)
    read = readings.select(F.col("uri").alias("_uri"), F.col("target").alias("_target"), "at")
    met = (F.col("uri") == F.col("_uri")) & (F.col("target") == F.col("_target")) & (F.col("at") >= F.col("created_at")) & (F.col("at") <= F.col("due_at"))
    return due.join(read, met, "left_anti").select("uri", "target", "due_at")


def _hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))
