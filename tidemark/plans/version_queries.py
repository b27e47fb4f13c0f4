"""Versions, increments, windows and features over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import versions as V
from tidemark.plans import backtest_queries as Q
from tidemark.plans import substrate as S
from tidemark.plans.catalog import query, r6, s6


def baskets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(artist, item) as stored, and as found now: line status F alone was known before."""
    lines = S.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("artist"), F.col("l_suppkey").alias("item"), "l_linestatus", "l_returnflag")
    return lines.where("l_returnflag <> 'R'").select("artist", "item"), lines.where("l_linestatus = 'F' or l_returnflag <> 'R'").select("artist", "item")


BASKETS = """WITH o AS (SELECT DISTINCT l_orderkey AS artist, l_suppkey AS item FROM lineitem WHERE l_returnflag <> 'R'), n AS (SELECT DISTINCT l_orderkey AS artist, l_suppkey AS item FROM lineitem WHERE l_linestatus = 'F' OR l_returnflag <> 'R'),
    c AS (SELECT coalesce(o.artist, n.artist) AS artist, count(o.item) AS a, count(n.item) AS b, count(*) FILTER (WHERE o.item IS NULL OR n.item IS NULL) AS d FROM o FULL JOIN n ON o.artist = n.artist AND o.item = n.item GROUP BY 1),
    ch AS (SELECT artist, CASE WHEN a = 0 THEN 'added' WHEN b = 0 THEN 'removed' ELSE 'changed' END AS change FROM c WHERE d > 0)"""


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = baskets(spark, sf_dir)
    return V.changed_keys(V.fingerprinted(new, ["artist"], ["item"]), V.fingerprinted(old, ["artist"], ["item"]), ["artist"])


@query(BASKETS + " SELECT artist, change FROM ch")
def fingerprint_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose set of items is not what it was."""
    return changed(spark, sf_dir)


@query(BASKETS + " SELECT artist, item FROM o WHERE artist NOT IN (SELECT artist FROM ch) UNION ALL SELECT artist, item FROM n WHERE artist IN (SELECT artist FROM ch)")
def replace_changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored items with those of changed keys deleted and written anew."""
    old, new = baskets(spark, sf_dir)
    return V.replace_keys(old.distinct(), new.distinct(), changed(spark, sf_dir), ["artist"])


@query("""SELECT 'metric' AS kind, o_orderpriority AS version, o_orderpriority = '1-URGENT' AS active, CASE WHEN o_orderpriority = '1-URGENT' THEN TIMESTAMP '2001-01-01 00:00:00' ELSE max(o_orderdate) END AS activated_at FROM orders GROUP BY o_orderpriority
    UNION ALL SELECT 'brief', o_orderstatus, TRUE, max(o_orderdate) FROM orders GROUP BY o_orderstatus""")
def activate_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version of a kind put in, the kind's others put out, the other kind untouched."""
    orders = S.read(spark, sf_dir, "orders")
    of = lambda kind, c: orders.groupBy(F.col(c).alias("version")).agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("activated_at")).select(F.lit(kind).alias("kind"), "version", F.lit(True).alias("active"), "activated_at")
    return V.activated(of("metric", "o_orderpriority").unionByName(of("brief", "o_orderstatus")), "1-URGENT", "metric", F.lit("2001-01-01 00:00:00"))


@query("SELECT CAST(date_trunc('week', o_orderdate) AS DATE) - 14 AS \"from\", CAST(date_trunc('week', o_orderdate) AS DATE) - 1 AS \"to\", count(*) AS n FROM orders GROUP BY 1, 2")
def closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two closed weeks that a run at each order's time would collect, with the number of such runs."""
    return S.read(spark, sf_dir, "orders").select(V.closed_window(F.col("o_orderdate")).alias("w")).groupBy("w.from", "w.to").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT c_mktsegment, list_sort(list(c_acctbal)) AS v FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1)
    SELECT c_custkey, CASE WHEN c_acctbal < v[1 + len(v) // 3] THEN 'low' WHEN c_acctbal < v[1 + 2 * len(v) // 3] THEN 'middle' ELSE 'high' END AS third FROM customer JOIN s USING (c_mktsegment)""")
def tercile_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cut_in_three(S.read(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"], ["c_custkey"]).select("c_custkey", "third")


@query(S.sql("conv lst sup", "SELECT week, genre FROM conv INTERSECT SELECT week, genre FROM lst INTERSECT SELECT week, genre FROM sup INTERSECT SELECT week, n_nationkey FROM nation, (SELECT DISTINCT week FROM conv)"))
def common_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks and categories that conversation, listening, supply and the full grid all have."""
    conv = S.conversation(spark, sf_dir)
    whole = conv.select("week").distinct().crossJoin(S.categories(spark, sf_dir).select("genre"))
    return V.common_keys([conv, S.listening(spark, sf_dir), S.supply(spark, sf_dir), whole], ["week", "genre"])


@query("SELECT conv_id, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS words, count(*) AS turns FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def list_length_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = S.read(spark, sf_dir, "conversations").where("text is not null")
    return own.groupBy("conv_id").agg(F.sum(F.size(F.split("text", " ", -1))).cast("long").alias("words"), F.count(F.lit(1)).alias("turns"))


FEATURES = """, v AS (SELECT label AS genre, arg_min(embedding, vec_id) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL GROUP BY label),
    h AS (SELECT grid.genre, week, ln(1 + conv) AS x, ln(1 + listen) AS l, ln(1 + releases) AS s, e FROM grid LEFT JOIN v ON v.genre = grid.genre),
    tp AS (SELECT * FROM h WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY week ORDER BY coalesce((x + l) / 2 - s, x) DESC NULLS LAST, genre) <= 10),
    ct AS (SELECT week, i, avg(CAST(e[i] AS DOUBLE)) AS m FROM tp CROSS JOIN (SELECT unnest(generate_series(1, (SELECT max(len(embedding)) FROM embeddings))) AS i) WHERE i <= len(e) GROUP BY 1, 2),
    sm AS (SELECT h.genre, h.week, sum(CAST(h.e[i] AS DOUBLE) * m) / nullif(sqrt(sum(CAST(h.e[i] AS DOUBLE) * h.e[i])) * sqrt(sum(m * m)), 0) AS sim FROM h JOIN ct ON ct.week = h.week WHERE h.e IS NOT NULL GROUP BY 1, 2)"""


@query(S.sql("grid", FEATURES + f""" SELECT a.genre, a.week AS origin, a.week + 14 AS target_week, {s6('a.x')} AS target_lag_1, {s6('b.x')} AS target_lag_2, {s6('c.x')} AS target_lag_3, {s6('d.x')} AS target_lag_4, {s6('a.l')} AS l, {s6('a.s')} AS s,
    {s6('coalesce(sim, 0)')} AS trend_similarity, CAST(week(a.week + 14) AS DOUBLE) AS week_of_year, CAST(dense_rank() OVER (ORDER BY a.genre) - 1 AS DOUBLE) AS category_code
    FROM h a LEFT JOIN h b ON b.genre = a.genre AND b.week = a.week - 7 LEFT JOIN h c ON c.genre = a.genre AND c.week = a.week - 14 LEFT JOIN h d ON d.genre = a.genre AND d.week = a.week - 21 LEFT JOIN sm ON sm.genre = a.genre AND sm.week = a.week"""))
def forecast_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every origin for the conversation two weeks ahead."""
    first = S.read(spark, sf_dir, "embeddings").where("label is not null and embedding is not null").groupBy(F.col("label").alias("genre")).agg(F.min_by("embedding", "vec_id").alias("e"))
    df = S.grid(spark, sf_dir).select("genre", "week", F.ln(1 + F.col("conv")).alias("x"), F.ln(1 + F.col("listen")).alias("l"), F.ln(1 + F.col("releases")).alias("s")).join(first, "genre", "left")
    df = df.withColumn("o", (F.col("x") + F.col("l")) / 2 - F.col("s"))
    out = B.features(df, "genre", "week", "x", ["l", "s"], 2, opportunity="o", fallback="x", embedding="e")
    plain = ("genre", "origin", "target_week", "week_of_year", "category_code")
    return out.select(*plain, *(r6(c).alias(c) for c in out.columns if c not in plain))


@query(S.sql("grid", Q.REC.replace("training_weeks >= 8", "training_weeks >= 1") + f""", f AS (SELECT * FROM rec WHERE model = 'seasonal' AND horizon = 1),
    cu AS (SELECT genre, week, ln(1 + releases) AS s, (ln(1 + conv) + ln(1 + listen)) / 2 - ln(1 + releases) AS o, ln(1 + conv) <= quantile_cont(ln(1 + conv), 0.9) OVER (PARTITION BY week) AS breakout FROM grid),
    j AS (SELECT cu.genre, cu.week AS origin, o, s, (a.predicted + b.predicted) / 2 - s AS predicted, (a.low + b.low) / 2 - (s + 0.05) AS l0, (a.high + b.high) / 2 - (s - 0.05) AS h0 FROM cu JOIN f a ON a.genre = cu.genre AND a.origin = cu.week AND a.axis = 'conversation' JOIN f b ON b.genre = cu.genre AND b.origin = cu.week AND b.axis = 'listening' WHERE breakout AND o IS NOT NULL),
    w AS (SELECT genre, origin, o, predicted, least(predicted, l0) AS low, greatest(predicted, h0) AS high, predicted - o AS gain FROM j)
    SELECT origin, genre, CAST(row_number() OVER (PARTITION BY origin ORDER BY gain DESC, genre) AS INTEGER) AS place, {s6('predicted')} AS predicted, {s6('low')} AS low, {s6('high')} AS high, {s6('gain')} AS gain, {s6('least(gain, low - (o + 0.1))')} AS gain_low, {s6('greatest(gain, high - (o - 0.1))')} AS gain_high FROM w"""))
def next_up_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakouts of every origin for which both axes have a seasonal forecast, ranked by predicted gain within the origin,
    with worst and best cases."""
    rec = B.persistent(Q.series(spark, sf_dir), Q.KEYS, "week", "x", [1], minimum=1).where("model = 'seasonal'")
    now = S.grid(spark, sf_dir).select("genre", F.col("week").alias("origin"), F.ln(1 + F.col("conv")).alias("c"), F.ln(1 + F.col("listen")).alias("l"), F.ln(1 + F.col("releases")).alias("s"))
    now = now.withColumn("breakout", F.col("c") <= F.percentile("c", F.lit(0.9)).over(Window.partitionBy("origin"))).withColumn("o", (F.col("c") + F.col("l")) / 2 - F.col("s"))
    around = lambda c, name, by: [F.col(c).alias(name), (F.col(c) - by).alias(f"{name}_low"), (F.col(c) + by).alias(f"{name}_high")]
    now = now.select("genre", "origin", "breakout", *around("o", "opportunity", 0.1), *around("s", "supply", 0.05))
    axes = [rec.where(F.col("axis") == a).select("genre", "origin", "predicted", "low", "high") for a in ("conversation", "listening")]
    out = B.next_up(now, axes, ["genre", "origin"], "origin")
    return out.select("origin", "genre", "place", *(r6(c).alias(c) for c in ("predicted", "low", "high", "gain", "gain_low", "gain_high")))
