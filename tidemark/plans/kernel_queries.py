"""Kernels over the weekly grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.operators import metrics as M
from tidemark.plans import substrate as S
from tidemark.plans.catalog import query, r6, s6

Z = lambda value, by: f"""(CASE WHEN {value} IS NULL THEN NULL WHEN stddev_pop({value}) OVER (PARTITION BY {by}) <= 1e-12 THEN 0.0
    ELSE ({value} - avg({value}) OVER (PARTITION BY {by})) / stddev_pop({value}) OVER (PARTITION BY {by}) END)"""  # noqa: E731


@query(S.sql("conv", f""", z AS (SELECT week, genre, conv, {Z('ln(1 + conv)', 'week')} AS z FROM conv)
    SELECT week, genre, {s6('conv')} AS conv, {s6('z - avg(z) OVER (PARTITION BY week)')} AS z FROM z"""))
def weekly_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: weekly index of conversation by category."""
    df = S.conversation(spark, sf_dir).withColumn("x", F.ln(1 + F.col("conv")))
    return K.zscores(df, "x", ["week"]).select("week", "genre", r6("conv").alias("conv"), r6("z").alias("z"))


@query(S.sql("grid", f""", z AS (SELECT week, genre, family, {Z('ln(1 + listen)', 'week, family')} AS z FROM grid)
    SELECT week, genre, family, {s6('z - avg(z) OVER (PARTITION BY week, family)')} AS z FROM z"""))
def peer_family_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.grid(spark, sf_dir).withColumn("x", F.ln(1 + F.col("listen")))
    return K.zscores(df, "x", ["week", "family"]).select("week", "genre", "family", r6("z").alias("z"))


BB = """{pre} AS (SELECT *, sum({c}) OVER ({w}) AS {p}t, count({c}) OVER ({w}) AS {p}g FROM {src}),
    {pre}2 AS (SELECT *, CASE WHEN {p}t > 1e-12 THEN {c} / {p}t END AS {p}s FROM {pre}),
    {pre}3 AS (SELECT *, var_pop({p}s) OVER ({w}) AS {p}v, 1.0 / {p}g AS {p}p FROM {pre}2),
    {pre}4 AS (SELECT *, greatest(least({p}p * (1 - {p}p) / greatest({p}v - {p}p * (1 - {p}p) / nullif({p}t, 0), 1e-12) - 1, 1e6), 1e-12) AS {p}c FROM {pre}3),
    {out} AS (SELECT *, CASE WHEN {c} IS NULL THEN NULL WHEN {p}t > 1e-12 THEN ({c} + {p}p * {p}c) / ({p}t + {p}c) ELSE {p}p END AS {p}post,
        CASE WHEN {c} IS NULL THEN NULL WHEN {p}t > 1e-12 THEN {p}c / ({p}t + {p}c) ELSE 1.0 END AS {p}wt FROM {pre}4)"""


@query(S.sql("conv", "," + BB.format(pre="a", src="conv", c="conv", w="PARTITION BY week", p="b_", out="o") + f"""
    SELECT week, genre, {s6('b_post')} AS posterior, {s6('b_post * b_t')} AS posterior_count, {s6('b_wt')} AS weight FROM o"""))
def beta_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = K.beta_binomial(S.conversation(spark, sf_dir), "conv", ["week"])
    return df.select("week", "genre", *(r6(c).alias(c) for c in ("posterior", "posterior_count", "weight")))


GP = """{pre} AS (SELECT *, {mean} AS {p}m, var_pop({c}) OVER ({w}) AS {p}v FROM {src}),
    {pre}2 AS (SELECT *, greatest(least(CASE WHEN {p}v > {p}m + 1e-12 THEN {p}m * {p}m / nullif({p}v - {p}m, 0) ELSE 1e6 END, 1e6), 1e-12) AS {p}k FROM {pre}),
    {out} AS (SELECT *, CASE WHEN {c} IS NULL THEN NULL WHEN {p}m > 1e-12 THEN ({c} + {p}k) / (1 + {p}k / {p}m) ELSE 0.0 END AS {p}post,
        CASE WHEN {c} IS NULL THEN NULL WHEN {p}m > 1e-12 THEN ({p}k / {p}m) / (1 + {p}k / {p}m) ELSE 1.0 END AS {p}wt FROM {pre}2)"""


@query(S.sql("sup", "," + GP.format(pre="a", src="sup", c="releases", w="PARTITION BY week", mean="avg(releases) OVER (PARTITION BY week)", p="g_", out="o") + f"""
    SELECT week, genre, {s6('g_post')} AS posterior, {s6('g_wt')} AS weight FROM o"""))
def gamma_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = K.gamma_poisson(S.supply(spark, sf_dir), "releases", ["week"])
    return df.select("week", "genre", r6("posterior").alias("posterior"), r6("weight").alias("weight"))


@query(S.sql("conv", ", fam AS (SELECT week, family, sum(conv) AS f FROM conv GROUP BY week, family),"
    + BB.format(pre="a", src="fam", c="f", w="PARTITION BY week", p="f_", out="fo") + ","
    + BB.format(pre="b", src="conv", c="conv", w="PARTITION BY week, family", p="w_", out="wo") + f"""
    SELECT week, genre, {s6('f_post * w_post')} AS posterior, {s6('f_post * w_post * sum(conv) OVER (PARTITION BY week)')} AS posterior_count,
        {s6('1 - (1 - w_wt) * (1 - f_wt)')} AS weight FROM wo JOIN fo USING (week, family)"""))
def hier_beta_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = K.hierarchical_beta_binomial(S.conversation(spark, sf_dir), "conv", ["week"], "family")
    return df.select("week", "genre", *(r6(c).alias(c) for c in ("posterior", "posterior_count", "weight")))


@query(S.sql("grid", ", x AS (SELECT week, genre, family, releases FROM grid WHERE releases IS NOT NULL), fam AS (SELECT week, family, avg(releases) AS f FROM x GROUP BY week, family),"
    + GP.format(pre="a", src="fam", c="f", w="PARTITION BY week", mean="avg(f) OVER (PARTITION BY week)", p="f_", out="fo") + ", j AS (SELECT * FROM x JOIN (SELECT week, family, f_post, f_wt FROM fo) USING (week, family)),"
    + GP.format(pre="b", src="j", c="releases", w="PARTITION BY week, family", mean="f_post", p="w_", out="wo") + f"""
    SELECT week, genre, {s6('w_post')} AS posterior, {s6('1 - (1 - w_wt) * (1 - f_wt)')} AS weight FROM wo"""))
def hier_gamma_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = K.hierarchical_gamma_poisson(S.grid(spark, sf_dir).where("releases is not null"), "releases", ["week"], "family")
    return df.select("week", "genre", r6("posterior").alias("posterior"), r6("weight").alias("weight"))


@query(S.sql("post eng", f"""SELECT genre, {s6('coalesce(sum(w) * sum(w) / nullif(sum(w * w), 0), 0)')} AS effective_n, count(*) AS n
    FROM (SELECT genre, 1 + 0.5 * likes + 1.5 * reposts + replies AS w FROM post JOIN eng USING (post_id)) GROUP BY genre"""))
def kish_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = 1 + 0.5 * F.col("likes") + 1.5 * F.col("reposts") + F.col("replies")
    own = S.posts(spark, sf_dir).join(S.engagement(spark, sf_dir), "post_id").withColumn("w", w)
    return own.groupBy("genre").agg(r6(K.kish(F.col("w"))).alias("effective_n"), F.count(F.lit(1)).alias("n"))


@query(S.sql("conv", f""", p AS (SELECT week, conv / sum(conv) OVER (PARTITION BY week) AS p, row_number() OVER (PARTITION BY week ORDER BY conv DESC, genre) AS r FROM conv)
    SELECT week, {s6('sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END)')} AS entropy, {s6('exp(sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END))')} AS diversity,
        {s6('sum(p * p)')} AS hhi, {s6('sum(CASE WHEN r <= 10 THEN p ELSE 0 END)')} AS top_share FROM p GROUP BY week"""))
def entropy_hhi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = K.concentration(S.conversation(spark, sf_dir), "conv", ["week"], 10, "genre")
    return df.select("week", r6("entropy").alias("entropy"), r6(F.exp("entropy")).alias("diversity"), r6("hhi").alias("hhi"), r6("top_share").alias("top_share"))


@query(S.sql("conv", f""", t AS (SELECT week, genre FROM conv QUALIFY row_number() OVER (PARTITION BY week ORDER BY conv DESC, genre DESC) <= 8),
    s AS (SELECT week, count(*) AS n FROM t GROUP BY week),
    b AS (SELECT a.week, count(*) AS shared FROM t a JOIN t b ON b.week = a.week - 28 AND a.genre = b.genre GROUP BY a.week)
    SELECT s.week, {s6('CASE WHEN p.n IS NOT NULL THEN coalesce(shared, 0) / CAST(s.n + p.n - coalesce(shared, 0) AS DOUBLE) END')} AS jaccard
    FROM s LEFT JOIN s p ON p.week = s.week - 28 LEFT JOIN b ON b.week = s.week"""))
def jaccard_churn_4w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each week's leading categories with those of four calendar weeks before; NULL if that week is absent."""
    rank = F.row_number().over(Window.partitionBy("week").orderBy(F.col("conv").desc(), F.col("genre").desc()))
    tops = S.conversation(spark, sf_dir).withColumn("r", rank).where("r <= 8").groupBy("week").agg(F.collect_set("genre").alias("now"))
    before = tops.select(F.date_add("week", 28).alias("week"), F.col("now").alias("before"))
    return tops.join(before, "week", "left").select("week", r6(K.jaccard(F.col("now"), F.col("before"))).alias("jaccard"))


EWMA_SQL = """, n AS (SELECT {key}, week, {x} AS x, row_number() OVER (PARTITION BY {key} ORDER BY week) AS i FROM {src}),
    e AS (SELECT {key}, week, i, x AS s, x AS o FROM n WHERE i = 1
        UNION ALL SELECT {nk}, n.week, n.i, CASE WHEN n.x IS NULL THEN e.s WHEN e.s IS NULL THEN n.x ELSE {a} * n.x + (1 - {a}) * e.s END,
            CASE WHEN n.x IS NULL THEN NULL WHEN e.s IS NULL THEN n.x ELSE {a} * n.x + (1 - {a}) * e.s END
        FROM e JOIN n ON {on} AND n.i = e.i + 1)"""
ALPHA = "(1 - exp(ln(0.5) / 3))"


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive(S.sql("grid", EWMA_SQL.format(key="genre", nk="n.genre", x="ln(1 + listen)", src="grid", a=ALPHA, on="n.genre = e.genre") + f"SELECT genre, week, {s6('o')} AS ewma FROM e")))
def ewma_gap_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.grid(spark, sf_dir).withColumn("x", F.ln(1 + F.col("listen")))
    return K.ewma(df, "x", ["genre"], "week").select("genre", "week", r6("ewma").alias("ewma"))


@query(_recursive(S.sql("grid", EWMA_SQL.format(key="genre", nk="n.genre", x="ln(1 + conv)", src="grid", a=ALPHA, on="n.genre = e.genre") + """,
    q AS (SELECT n.genre, n.week, n.x - e.o AS r FROM n JOIN e USING (genre, week))
    SELECT genre, week, coalesce(count(r) OVER w >= 2 AND stddev_pop(r) OVER w > 1e-12 AND r > 2.5 * stddev_pop(r) OVER w, FALSE) AS spike
    FROM q WINDOW w AS (PARTITION BY week)""")))
def spike_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.grid(spark, sf_dir).withColumn("x", F.ln(1 + F.col("conv")))
    return K.spikes(K.ewma(df, "x", ["genre"], "week"), "x", "ewma", ["week"]).select("genre", "week", "spike")


@query(S.sql("grid", """, q AS (SELECT week, quantile_cont(ln(1 + listen), 0.9) AS hi, median(ln(1 + conv)) AS mid FROM grid GROUP BY week)
    SELECT week, genre, ln(1 + listen) >= hi AND ln(1 + conv) < mid AS breakout FROM grid JOIN q USING (week)"""))
def breakout_q90(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.grid(spark, sf_dir).withColumn("a", F.ln(1 + F.col("listen"))).withColumn("b", F.ln(1 + F.col("conv")))
    return K.breakouts(df, "a", "b", ["week"]).select("week", "genre", "breakout")


@query(S.sql("delta", "SELECT genre, segment, week, status FROM delta"))
def window_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.deltas(spark, sf_dir).select("genre", "segment", "week", "status")


@query(S.sql("delta", """SELECT genre, segment, week, plays - last_plays AS delta_plays, listeners - last_listeners AS delta_listeners
    FROM delta WHERE last_plays <= plays AND last_listeners <= listeners"""))
def lag_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = S.deltas(spark, sf_dir).where("last_plays <= plays and last_listeners <= listeners")
    return own.select("genre", "segment", "week", (F.col("plays") - F.col("last_plays")).alias("delta_plays"), (F.col("listeners") - F.col("last_listeners")).alias("delta_listeners"))


@query(S.sql("grid", """, k AS (SELECT genre, week, week - CAST(row_number() OVER (PARTITION BY genre ORDER BY week) * 7 AS INTEGER) AS k FROM grid WHERE listen IS NOT NULL),
    r AS (SELECT genre, k, min(week) AS first_week, max(week) AS last_week, count(*) AS weeks FROM k GROUP BY genre, k)
    SELECT genre, first_week, last_week, weeks FROM r QUALIFY row_number() OVER (PARTITION BY genre ORDER BY last_week DESC) = 1"""))
def contiguous_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category's latest unbroken run of weeks with listening."""
    runs = K.islands(S.grid(spark, sf_dir).where("listen is not null"), ["genre"], "week")
    runs = runs.groupBy("genre", F.col("run").alias("first_week")).agg(F.max("week").alias("last_week"), F.count(F.lit(1)).alias("weeks"))
    last = F.row_number().over(Window.partitionBy("genre").orderBy(F.col("last_week").desc()))
    return runs.withColumn("r", last).where("r = 1").drop("r")


@query(S.sql("post eng", """, u AS (SELECT genre, post_id, 1 + 0.5 * likes + 1.5 * reposts + replies AS w FROM post JOIN eng USING (post_id)),
    d AS (SELECT genre, w, k, CAST(('0x' || substr(md5(CAST(post_id AS VARCHAR) || ':' || CAST(k // 4 AS VARCHAR)), 1 + 8 * (k % 4), 8)) AS BIGINT) / 4294967296.0 AS u FROM u, range(200) r(k)),
    s AS (SELECT genre, k, sum(w * CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5 ELSE 6 END) AS t FROM d GROUP BY genre, k),
    p AS (SELECT genre, sum(w) AS point FROM u GROUP BY genre)
    SELECT genre, """ + s6("any_value(point)") + " AS point, " + s6("least(quantile_cont(t, 0.05), any_value(point))") + " AS lower, " + s6("greatest(quantile_cont(t, 0.95), any_value(point))") + " AS upper FROM s JOIN p USING (genre) GROUP BY genre"))
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90 % intervals of the posts' weighted score by a Poisson bootstrap of 200 draws, from md5 numbers."""
    w = 1 + 0.5 * F.col("likes") + 1.5 * F.col("reposts") + F.col("replies")
    units = S.posts(spark, sf_dir).join(S.engagement(spark, sf_dir), "post_id").select("genre", "post_id", w.alias("w"))
    sums = M.resampled(units, ["genre"], F.col("post_id"), F.col("w"), 200).withColumnRenamed("value", "t")
    points = units.groupBy("genre").agg(F.sum("w").alias("point"))
    out = sums.join(points, "genre").groupBy("genre", "point").agg(K.interval(F.col("t"), F.col("point")).alias("ci"))
    return out.select("genre", r6("point").alias("point"), r6("ci.lower").alias("lower"), r6("ci.upper").alias("upper"))
