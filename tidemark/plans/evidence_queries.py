"""Evidence, receipts, ecosystem and the pooled forecast over the test tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import evidence as V
from tidemark.plans import substrate as S
from tidemark.plans.catalog import query, r6, s6

EVIDENCE = """WITH p AS (SELECT o_orderkey AS post_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM orders),
    k AS (SELECT l_orderkey AS post_id, l_suppkey AS artist, CASE WHEN l_linestatus = 'F' THEN 'mbid' ELSE 'name' END AS kind, l_extendedprice AS score, l_partkey FROM lineitem),
    b AS (SELECT post_id, artist FROM k QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY (kind = 'mbid') DESC, score DESC, artist) = 1),
    m AS (SELECT s_suppkey AS artist, s_nationkey AS genre, 0.7 AS weight, 0.9 AS confidence FROM supplier UNION ALL SELECT s_suppkey, (s_nationkey + 1) % 25, 0.3, 0.6 FROM supplier),
    r AS (SELECT l_orderkey AS post_id, CASE WHEN l_returnflag = 'R' THEN 72 WHEN l_returnflag = 'A' THEN 24 END AS target, 2.0 * l_quantity AS hours, l_partkey AS likes FROM lineitem),
    q AS (SELECT post_id, likes FROM r WHERE target = 72 OR target IS NULL AND hours >= 60 QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY hours DESC, likes DESC) = 1),
    e AS (SELECT week, genre, post_id, CAST(weight AS DOUBLE) AS weight, likes, likes IS NOT NULL AS mature FROM p JOIN b USING (post_id) JOIN m USING (artist) LEFT JOIN q USING (post_id))"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.read(spark, sf_dir, "lineitem")
    posts = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post_id"), S.week(F.col("o_orderdate")).alias("week"))
    links = lines.select(F.col("l_orderkey").alias("post_id"), F.col("l_suppkey").alias("artist"), F.when(F.col("l_linestatus") == "F", "mbid").otherwise("name").alias("kind"), F.col("l_extendedprice").alias("score"))
    supplier = S.read(spark, sf_dir, "supplier")
    member = lambda genre, weight, confidence: supplier.select(F.col("s_suppkey").alias("artist"), genre.alias("genre"), F.lit(weight).alias("weight"), F.lit(confidence).alias("confidence"))
    members = member(F.col("s_nationkey"), 0.7, 0.9).unionByName(member((F.col("s_nationkey") + 1) % 25, 0.3, 0.6))
    polls = lines.select(F.col("l_orderkey").alias("post_id"), F.when(F.col("l_returnflag") == "R", 72).when(F.col("l_returnflag") == "A", 24).alias("target"), (2.0 * F.col("l_quantity")).alias("hours"), F.col("l_partkey").alias("likes"))
    return V.conversation(posts, links, members, polls)


@query(EVIDENCE + " SELECT week, genre, post_id, weight, likes, mature FROM e")
def conversation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir)


@query(EVIDENCE + " SELECT e.week, e.genre, e.post_id, o_totalprice FROM e JOIN orders ON o_orderkey = e.post_id WHERE mature")
def receipts_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of mature posts, joined to their orders."""
    source = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post_id"), "o_totalprice")
    return V.refreshed(V.receipts(evidence(spark, sf_dir).where("mature"), "post_id"), source, "post_id").select("week", "genre", "post_id", "o_totalprice")


@query(f"""WITH c AS (SELECT DISTINCT l_partkey AS release, l_suppkey AS artist FROM lineitem), m AS (SELECT s_suppkey AS artist, s_nationkey AS genre, 1.0 / (1 + s_suppkey % 3) + 0.01 AS weight FROM supplier),
    w AS (SELECT release, genre, CAST(max(weight) AS DOUBLE) AS weight FROM c JOIN m USING (artist) GROUP BY 1, 2)
    SELECT release, genre, {s6('weight / sum(weight) OVER (PARTITION BY release)')} AS weight FROM w""")
def supply_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    credits = S.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("release"), F.col("l_suppkey").alias("artist")).distinct()
    members = S.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("artist"), F.col("s_nationkey").alias("genre"), (1.0 / (1 + F.col("s_suppkey") % 3) + 0.01).alias("weight"))
    return V.supply(credits, members).select("release", "genre", r6("weight").alias("weight"))


@query(S.sql("conv", f""", p AS (SELECT week, family, conv / sum(conv) OVER w AS p, row_number() OVER (PARTITION BY week, family ORDER BY conv DESC, genre) AS r FROM conv WINDOW w AS (PARTITION BY week, family))
    SELECT week, family, {s6('sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END)')} AS entropy, {s6('sum(p * p)')} AS hhi, {s6('sum(CASE WHEN r <= 3 THEN p ELSE 0 END)')} AS top_share FROM p GROUP BY week, family"""))
def family_ecosystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.ecosystem(S.conversation(spark, sf_dir), "conv", 3, "family")
    return df.select("week", "family", r6("entropy").alias("entropy"), r6("hhi").alias("hhi"), r6("top_share").alias("top_share"))


@query("""WITH r AS (SELECT 'old' AS run_id, TIMESTAMP '2024-01-02 00:00:00' AS started_at, TIMESTAMP '2024-01-09 00:00:00' AS finished_at UNION ALL SELECT 'new', TIMESTAMP '2024-01-09 00:00:00', TIMESTAMP '2024-01-16 00:00:00')
    SELECT run_id, count(ts) AS events FROM r LEFT JOIN events ON ts >= started_at AND ts < finished_at GROUP BY run_id""")
def pipeline_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the events that fell into each run; the second run was started again and so reset."""
    row = lambda *x: spark.createDataFrame([x], "run_id string, a string, b string").select("run_id", F.col("a").cast("timestamp").alias("started_at"), F.col("b").cast("timestamp").alias("finished_at"))
    runs = row("old", "2024-01-02", "2024-01-09").unionByName(row("new", "2023-01-01", "2023-01-02"))
    events = S.read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"))
    return V.manifest(runs, row("new", "2024-01-09", "2024-01-16"), {"events": events}).select("run_id", "events")


#: The cut of the query below: what lies before it is learned from. A parameter of the binding to the test tables.
LEARNED_TO = datetime.date(2000, 6, 5)


@query(None)
def gbm_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-week forecasts by quantile boosting pooled over categories, fitted once at a cut and scored after it: no SQL."""
    by = ["genre", "family", "axis"]
    x = S.grid(spark, sf_dir).select("genre", "family", F.lit("conversation").alias("axis"), "week", F.ln(1 + F.col("conv")).alias("x"))
    out = B.boosted(B.pooled_examples(x, *by, "week", "x", [2]), [LEARNED_TO], by, "axis", minimum=1, rounds=10)
    return out.where(F.col("origin") > F.lit(LEARNED_TO)).select("genre", "origin", *(r6(c).alias(c) for c in ("predicted", "low", "high", "actual")))
