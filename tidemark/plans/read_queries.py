"""The read surface and the streams over the test tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import reads as A
from tidemark.plans import substrate as S
from tidemark.plans.catalog import query, r6, s6
from tidemark.sources import tables as X
from tidemark.streaming import ingest as I

WEEK = datetime.date(2000, 6, 5)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.grid(spark, sf_dir).join(S.categories(spark, sf_dir).select("genre", "name"), "genre").withColumn("opportunity", F.ln(1 + F.col("listen")) - F.ln(1 + F.col("releases")))


BASE = ", b AS (SELECT g.*, n_name AS name, ln(1 + listen) - ln(1 + releases) AS opportunity FROM grid g JOIN nation ON n_nationkey = genre)"


@query(S.sql("grid", BASE + f" SELECT week, genre, {s6('opportunity')} AS opportunity FROM b WHERE week = DATE '2000-06-05' AND opportunity IS NOT NULL ORDER BY opportunity DESC, genre LIMIT 25"))
def read_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.opportunities(rows(spark, sf_dir), week=A.monday(WEEK, datetime.date(2001, 1, 1)))
    return own.select("week", "genre", r6("opportunity").alias("opportunity"))


@query(S.sql("grid", BASE + f" SELECT week, name, {s6('conv')} AS conv, {s6('listen')} AS listen FROM b WHERE lower(name) = (SELECT lower(min(n_name)) FROM nation) ORDER BY week DESC LIMIT 52"))
def read_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = S.read(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return A.timeseries(rows(spark, sf_dir), name.upper()).select("week", "name", r6("conv").alias("conv"), r6("listen").alias("listen"))


@query(S.sql("post eng", f"SELECT post_id, {s6('1 + 0.5 * likes + 1.5 * reposts + replies')} AS score FROM post JOIN eng USING (post_id) WHERE genre = 3 AND week = DATE '2000-06-05' ORDER BY 1 + 0.5 * likes + 1.5 * reposts + replies DESC, post_id LIMIT 50"))
def read_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = S.posts(spark, sf_dir).join(S.engagement(spark, sf_dir), "post_id").withColumn("score", 1 + 0.5 * F.col("likes") + 1.5 * F.col("reposts") + F.col("replies"))
    return A.evidence(own, genre=3, week=WEEK, order="score").select("post_id", r6("score").alias("score"))


@query(S.sql("grid", BASE + " SELECT max(week) AS week FROM b WHERE week < DATE '2001-01-01' AND opportunity IS NOT NULL"))
def read_latest_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest_week(rows(spark, sf_dir), F.lit("2001-01-03").cast("date"))


@query("SELECT n_nationkey AS genre, n_name AS name FROM nation WHERE lower(n_name) LIKE '%1%' ORDER BY NOT lower(n_name) LIKE '1%', n_name LIMIT 20")
def read_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.search(S.categories(spark, sf_dir), "1").select("genre", "name")


@query("SELECT (SELECT count(*) FROM orders) AS posts, (SELECT count(*) FROM lineitem) AS readings, (SELECT count(*) FROM nation) AS categories, max(o_orderdate) AS started_at FROM orders")
def read_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.read(spark, sf_dir, "orders")
    tables = {"posts": orders, "readings": S.read(spark, sf_dir, "lineitem"), "categories": S.read(spark, sf_dir, "nation")}
    return A.health(tables, orders.select(F.col("o_orderdate").alias("started_at")))


@query("""WITH u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m') WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)
    SELECT o_orderkey, CASE WHEN regexp_full_match(d, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(d AS DATE) END AS released FROM u""")
def full_dates_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(d, "yyyy-MM")).when(F.col("o_orderkey") % 7 == 0, F.date_format(d, "yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return S.read(spark, sf_dir, "orders").select("o_orderkey", X.full_date(text).alias("released"))


@query("SELECT count(*) FILTER (WHERE NOT coalesce(c_acctbal >= 0, FALSE)) AS negative, count(*) FILTER (WHERE c_name IS NULL) AS nameless FROM customer")
def table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.violations(S.read(spark, sf_dir, "customer"), {"negative": F.col("c_acctbal") >= 0, "nameless": F.col("c_name").isNotNull()})


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n, " + s6("sum(value)") + " AS value FROM events GROUP BY 1, 2")
def stream_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of Parquet files: every batch updates its weeks, and the last state of each is the result.

    The stream's files and checkpoint are written to the shared folder of spark.checkpoint.dir.
    """
    folder = f"{X.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = S.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.withColumn("part", F.col("event_id") % 3).write.partitionBy("part").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    counts = stream.select(F.trunc(F.col("ts").cast("date"), "week").alias("week"), "event_type", "value").groupBy("week", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/out")

    counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    last = out.groupBy("week", "event_type").agg(F.max_by(F.struct("n", "value"), "batch").alias("s"))
    return last.select("week", "event_type", "s.n", r6("s.value").alias("value"))


@query("SELECT event_id, user_id, list_filter([CASE WHEN value > 50 THEN 'strong' END, CASE WHEN event_type = 'purchase' THEN 'buys' END, CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN 'keyed' END], lambda x: x IS NOT NULL) AS rules FROM events WHERE value > 50 OR event_type = 'purchase' OR json_extract_string(props, '$.k') IS NOT NULL")
def stream_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of JSON files, classified batch by batch; a batch that is repeated replaces itself."""
    folder = f"{X.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = S.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4, "event_id").write.json(f"{folder}/in")
    stream = I.classified(I.file_stream(spark, f"{folder}/in", files=2))
    I.write(stream, f"{folder}/state", I.append_once(f"{folder}/out")).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "rules")
