"""Streams with state and published tables over the test tables; the batch form's SQL must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import substrate as S
from tidemark.plans.catalog import query, r6, s6
from tidemark.sources import published as P
from tidemark.sources import tables as X
from tidemark.streaming import ingest as I
from tidemark.streaming import stateful as T

#: Rows arrive up to LATE hours after their time, in PARTS of so many days; a part's files come in any order. Watermarks wait
#: for longer than both together, so that nothing is dropped. A tenth of the rows comes twice.
LATE, DAYS, DELAY = 36, 8, "10 days"


def arriving(spark: SparkSession, rows: DataFrame, at: str, key: str) -> tuple[DataFrame, str]:
    """rows as a stream of Parquet files in the order of arrival, and its folder (in the session's shared one)."""
    folder = f"{X.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    late = lambda seed: F.col(at) + F.make_dt_interval(F.lit(0), F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(LATE)).cast("int"))
    again = rows.where(F.pmod(F.xxhash64(key), F.lit(10)) == 0)
    both = rows.withColumn("_arrives", late(1)).unionByName(again.withColumn("_arrives", late(2)))
    first = rows.agg(F.min(at)).first()[0]
    # dealt to parts once: a part read from its own folder leaves the other rows alone
    both.withColumn("_part", F.floor(F.datediff("_arrives", F.lit(first)) / DAYS).cast("int")).drop("_arrives").write.partitionBy("_part").parquet(f"{folder}/parts")
    parts = [r[0] for r in spark.read.parquet(f"{folder}/parts").select("_part").distinct().orderBy("_part").collect()]
    for part in parts:
        spark.read.schema(rows.schema).parquet(f"{folder}/parts/_part={part}").write.parquet(f"{folder}/in/{part:04d}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 16).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    return stream, folder


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters by user: the event's number, and its value, which can fall and is missing for errors of one kind."""
    events = S.read(spark, sf_dir, "events")
    listeners = F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), None).otherwise(F.floor("value").cast("long"))
    return events.select("event_id", F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("plays"), listeners.alias("listeners"))


STATUS = """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(date_trunc('week', ts) AS DATE) AS week, ts, event_id AS plays, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS listeners FROM events),
    l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key, week ORDER BY ts DESC, plays DESC) = 1),
    p AS (SELECT *, lag(week) OVER w AS last_week, lag(ts) OVER w AS last_ts, lag(plays) OVER w AS last_plays, lag(listeners) OVER w AS last_listeners FROM l WINDOW w AS (PARTITION BY key ORDER BY week))
    SELECT key, week, plays, listeners, last_plays, last_listeners, CASE WHEN last_week IS NULL THEN 'first_observation' WHEN listeners IS NULL OR last_listeners IS NULL THEN 'incomplete_pair' WHEN ts <= last_ts THEN 'invalid_order'
      WHEN week - last_week <> 7 THEN 'nonconsecutive_weeks' WHEN plays < last_plays OR listeners < last_listeners THEN 'counter_decrease' ELSE 'valid_weekly' END AS status FROM p"""


@query(STATUS)
def weekly_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form: every week's latest reading of each user, and how it relates to the one before."""
    out = T.with_status(T.weekly_pairs(readings(spark, sf_dir)))
    return out.select("key", "week", "plays", "listeners", "last_plays", "last_listeners", "status")


@query(STATUS + " WHERE week + 7 <= (SELECT max(ts) - INTERVAL 10 DAY FROM events)")
def stream_weekly_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream with state for each user, for weeks that the watermark has passed: rows come late, in any order
    within a part, and again."""
    stream, folder = arriving(spark, readings(spark, sf_dir), "at", "event_id")
    pairs = T.weekly_readings(stream.select("key", "at", "plays", "listeners"), DELAY)
    I.write(T.with_status(pairs), f"{folder}/state", I.append_once(f"{folder}/out")).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("key", "week", "plays", "listeners", "last_plays", "last_listeners", "status")


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uri, kind, target, at): every event as a post, some with a reading of one target or both, in time or too late."""
    events = S.read(spark, sf_dir, "events").select(F.col("event_id").alias("uri"), F.col("ts").cast("timestamp").alias("ts"))
    n = F.col("uri")
    reading = lambda target, hours, some: F.when(some, F.struct(F.lit("reading").alias("kind"), F.lit(target).alias("target"), (F.col("ts") + F.make_dt_interval(F.lit(0), hours.cast("int"))).alias("at")))
    kinds = F.array(F.struct(F.lit("post").alias("kind"), F.lit(0).alias("target"), F.col("ts").alias("at")), reading(24, 20 + n % 9, n % 4 != 0), reading(72, 66 + n % 13, n % 3 == 0))
    return events.select("uri", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("x")).select("uri", "x.*")


@query("""WITH t AS (SELECT unnest([24, 72]) AS target), d AS (SELECT event_id AS uri, target, ts + target * INTERVAL 1 HOUR AS due_at, CASE WHEN target = 24 THEN 20 + event_id % 9 ELSE 66 + event_id % 13 END AS hours,
      CASE WHEN target = 24 THEN event_id % 4 <> 0 ELSE event_id % 3 = 0 END AS is_read FROM events, t)
    SELECT uri, target, due_at FROM d WHERE NOT (is_read AND hours <= target) AND due_at < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 DAY FROM events)""")
def stream_unread_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls that fell due without a reading, as a stream that waits for each post's due times."""
    stream, folder = arriving(spark, polls(spark, sf_dir), "at", "uri")
    posts = stream.where("kind = 'post'").select("uri", F.col("at").alias("created_at"))
    due = T.unread(posts, stream.where("kind = 'reading'").select("uri", "target", "at"), delay=DELAY)
    I.write(due, f"{folder}/state", I.append_once(f"{folder}/out")).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("uri", "target", F.col("due_at").cast("timestamp_ntz").alias("due_at"))


@query(f"SELECT user_id, event_type, max(ts) AS ts, {s6('arg_max(value, (ts, value))')} AS value FROM events GROUP BY user_id, event_type")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream into a table that keeps the newest row of each user and kind of event; every batch is applied twice, as after
    a restart."""
    events = S.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    stream, folder = arriving(spark, events, "ts", "event_id")

    def sink(batch: DataFrame, number: int) -> None:
        for _ in range(2):
            P.upsert_latest(batch.drop("event_id"), number, f"{folder}/table", keys=["user_id", "event_type"], newest="ts", buckets=8)

    I.write(stream, f"{folder}/state", sink).awaitTermination()
    return P.rows_of(spark, f"{folder}/table").select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), r6("value").alias("value"))


@query(f"""WITH o AS (SELECT o_custkey AS customer, count(*) AS orders, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), old AS (SELECT o_custkey AS customer FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
    SELECT 'row' AS kind, customer, orders, {s6('total')} AS total FROM o UNION ALL SELECT 'withdrawn', customer, NULL, NULL FROM old WHERE customer NOT IN (SELECT customer FROM o)""")
def published_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published in two versions, the first with customers of pending orders; a third version, which breaks its checks,
    and one of an unfinished run are refused and leave no trace."""
    path = f"{X.shared_folder(spark)}/published-{uuid.uuid4().hex}"
    orders = S.read(spark, sf_dir, "orders")
    of = lambda df: df.groupBy(F.col("o_custkey").alias("customer")).agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))
    checks = {"orders": F.col("orders") > 0}
    P.publish(of(orders.where("o_orderstatus = 'P'")), path, "v1", keys=["customer"], checks=checks)
    second = P.publish(of(orders.where("o_orderstatus <> 'P'")), path, "v2", keys=["customer"], checks=checks)
    for version, rows, run in (("v3", of(orders).withColumn("orders", F.lit(0).cast("long")), None), ("v4", of(orders), P.finished(orders.select("o_orderkey"), orders.where("o_orderstatus = 'F'").select("o_orderkey"), ["o_orderkey"]))):
        try:
            P.publish(rows, path, version, keys=["customer"], checks=checks, run=run)
        except (P.Refused, P.Unfinished):
            continue
        raise AssertionError(f"{version} was published")
    own = P.rows_of(spark, path).select(F.lit("row").alias("kind"), "customer", "orders", r6("total").alias("total"))
    gone = P.rows_of(spark, path, second, kind="withdrawn").select(F.lit("withdrawn").alias("kind"), "customer", F.lit(None).cast("long").alias("orders"), F.lit(None).cast("double").alias("total"))
    return own.unionByName(gone)
