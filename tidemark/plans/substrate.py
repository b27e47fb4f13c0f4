"""The test tables bound to the abstract inputs: categories, posts, counters, releases, memberships, embeddings.

Category: nation; family: region; post: order of a customer; engagement: its lines; counter key: nation and market
segment; release: a part shipped by a supplier. Each function has its twin in SQL among SQL's common table expressions,
so that queries and their checks start from the same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def week(ts) -> F.Column:
    """The Monday of a timestamp's ISO week."""
    return F.trunc(ts.cast("date"), "week")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("genre"), F.col("n_regionkey").alias("family"), F.col("n_name").alias("name"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(post_id, author, genre, family, week, created_at)"""
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("author"), F.col("c_nationkey").alias("genre"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("author"), week(F.col("o_orderdate")).alias("week"), F.col("o_orderdate").alias("created_at"))
    # customers grow with their orders: compressed files make them look small enough to pass through the driver
    return orders.join(customers.hint("merge"), "author").join(categories(spark, sf_dir).select("genre", "family"), "genre")


def engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(post_id, likes, reposts, replies)"""
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("post_id")).agg(F.sum("l_quantity").alias("likes"), F.countDistinct("l_suppkey").alias("reposts"), F.count(F.lit(1)).alias("replies"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(week, genre, family, post_id, score): weighted engagement of the posts that have any reading."""
    score = 1 + 0.5 * F.col("likes") + 1.5 * F.col("reposts") + F.col("replies")
    return posts(spark, sf_dir).join(engagement(spark, sf_dir).hint("merge"), "post_id").select("week", "genre", "family", "post_id", score.alias("score"))


def summed(posts: DataFrame) -> DataFrame:
    """(week, genre, family, conv, posts) of scored posts."""
    return posts.groupBy("week", "genre", "family").agg(F.sum("score").alias("conv"), F.count(F.lit(1)).alias("posts"))


def conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(week, genre, family, conv, posts): weighted engagement of the posts that have any reading."""
    return summed(scored(spark, sf_dir))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(genre, segment, week, plays, listeners): cumulative counters, some of which fall."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("author"), F.col("c_nationkey").alias("genre"), F.col("c_mktsegment").alias("segment"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("author"), week(F.col("o_orderdate")).alias("week"), F.floor("o_totalprice").cast("long").alias("plays"))
    weekly = orders.join(customers.hint("merge"), "author").groupBy("genre", "segment", "week").agg(F.sum("plays").alias("plays"), F.count(F.lit(1)).alias("listeners"))
    w = Window.partitionBy("genre", "segment").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    total = weekly.select("genre", "segment", "week", F.sum("plays").over(w).alias("plays"), F.sum("listeners").over(w).alias("listeners"))
    return total.withColumn("plays", F.col("plays") - F.when(F.col("listeners") % 97 == 0, 1000000).otherwise(0))


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters with their previous reading and the status of the pair."""
    from tidemark.functions.kernels import counter_status

    w = Window.partitionBy("genre", "segment").orderBy("week")
    own = counters(spark, sf_dir).select("*", F.lag("week").over(w).alias("last_week"), F.lag("plays").over(w).alias("last_plays"), F.lag("listeners").over(w).alias("last_listeners"))
    status = counter_status(F.col("week"), F.col("last_week"), [F.col("plays"), F.col("listeners")], [F.col("last_plays"), F.col("last_listeners")])
    return own.withColumn("status", status)


def gained(pairs: DataFrame) -> DataFrame:
    """(week, genre, listen) of valid pairs."""
    gain = (F.col("plays") - F.col("last_plays")) + 5 * (F.col("listeners") - F.col("last_listeners"))
    return pairs.groupBy("week", "genre").agg(F.sum(gain).cast("double").alias("listen"))


def listening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(week, genre, listen): weighted increases of the valid pairs."""
    return gained(deltas(spark, sf_dir).where("status = 'valid_weekly'"))


def released(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(week, genre, l_partkey), each once."""
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("genre"))
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", week(F.col("l_shipdate")).alias("week"))
    return lines.join(suppliers, "l_suppkey").select("week", "genre", "l_partkey").distinct()


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(week, genre, releases)"""
    return counted(released(spark, sf_dir))


def counted(parts: DataFrame) -> DataFrame:
    """(week, genre, releases) of released parts."""
    return parts.groupBy("week", "genre").agg(F.count("l_partkey").cast("double").alias("releases"))


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(week, genre, family, conv, posts, listen): the grid without supply."""
    return conversation(spark, sf_dir).join(listening(spark, sf_dir), ["week", "genre"], "left")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(week, genre, family, conv, posts, listen, releases): weeks with conversation; NULL where an axis has nothing."""
    return demand(spark, sf_dir).join(supply(spark, sf_dir), ["week", "genre"], "left")


SQL = {
    "post": """SELECT o_orderkey AS post_id, o_custkey AS author, c_nationkey AS genre, n_regionkey AS family,
        CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_orderdate AS created_at
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "eng": """SELECT l_orderkey AS post_id, sum(l_quantity) AS likes, count(DISTINCT l_suppkey) AS reposts, count(*) AS replies
        FROM lineitem GROUP BY l_orderkey""",
    "conv": """SELECT week, genre, family, sum(1 + 0.5 * likes + 1.5 * reposts + replies) AS conv, count(*) AS posts
        FROM post JOIN eng USING (post_id) GROUP BY week, genre, family""",
    "cnt0": """SELECT c_nationkey AS genre, c_mktsegment AS segment, CAST(date_trunc('week', o_orderdate) AS DATE) AS week,
        CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS plays, count(*) AS listeners
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "cnt1": """SELECT genre, segment, week, CAST(sum(plays) OVER w AS BIGINT) AS plays, CAST(sum(listeners) OVER w AS BIGINT) AS listeners
        FROM cnt0 WINDOW w AS (PARTITION BY genre, segment ORDER BY week ROWS UNBOUNDED PRECEDING)""",
    "cnt": """SELECT genre, segment, week, plays - CASE WHEN listeners % 97 = 0 THEN 1000000 ELSE 0 END AS plays, listeners FROM cnt1""",
    "lagged": """SELECT *, lag(week) OVER w AS last_week, lag(plays) OVER w AS last_plays, lag(listeners) OVER w AS last_listeners
        FROM cnt WINDOW w AS (PARTITION BY genre, segment ORDER BY week)""",
    "delta": """SELECT *, CASE WHEN last_week IS NULL THEN 'first_observation' WHEN week - last_week <> 7 THEN 'nonconsecutive_weeks'
        WHEN plays < last_plays OR listeners < last_listeners THEN 'counter_decrease' ELSE 'valid_weekly' END AS status FROM lagged""",
    "lst": """SELECT week, genre, CAST(sum((plays - last_plays) + 5 * (listeners - last_listeners)) AS DOUBLE) AS listen
        FROM delta WHERE status = 'valid_weekly' GROUP BY week, genre""",
    "sup": """SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, s_nationkey AS genre, CAST(count(DISTINCT l_partkey) AS DOUBLE) AS releases
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "grid": """SELECT conv.*, listen, releases FROM conv LEFT JOIN lst USING (week, genre) LEFT JOIN sup USING (week, genre)""",
}
NEEDS = {"conv": ["post", "eng"], "cnt1": ["cnt0"], "cnt": ["cnt1"], "lagged": ["cnt"], "delta": ["lagged"], "lst": ["delta"], "grid": ["conv", "lst", "sup"]}


def sql(names: str, body: str) -> str:
    """body after the common table expressions that `names` need; body may begin with its own, after a comma."""
    done: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in done:
            done.append(name)

    for name in names.split():
        add(name)
    own = ",\n".join(f"{n} AS ({SQL[n]})" for n in done)
    body = body.strip()
    return f"WITH {own}{body}" if body.startswith(",") else (f"WITH {own}\n{body}" if own else body)
