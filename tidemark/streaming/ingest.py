"""Streams of posts: parse, classify, keep the latest, and measure maturity; exactly what the batch operators give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.texts import fired

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def file_stream(spark: SparkSession, path: str, schema: str = EVENT, files: int = 1) -> DataFrame:
    """JSON files as a stream, `files` a batch; offsets are the checkpoint's."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def classified(events: DataFrame) -> DataFrame:
    """Projection and rules without state: the same for streams and tables."""
    rules = {"strong": F.col("value") > 50, "buys": F.col("event_type") == "purchase", "keyed": F.get_json_object("props", "$.k").isNotNull()}
    return events.select("event_id", "ts", "user_id", fired(rules).alias("rules")).where(F.size("rules") > 0)


def deduplicated(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Each event once, for as long as the watermark remembers it."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def weekly(events: DataFrame, delay: str = "84 hours") -> DataFrame:
    """Events by ISO week and type; a week is final once the watermark has passed its end."""
    week = F.window("ts", "7 days", startTime="4 days")  # the epoch is a Thursday
    return events.withWatermark("ts", delay).groupBy(week.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").cast("date").alias("week"), "event_type", "n", "value")


def write(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """All that is there now, batch by batch, into sink; a restart continues behind the last batch."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a partition of its own, so that a batch that is repeated replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return sink
