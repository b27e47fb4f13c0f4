"""Composite metrics, coverage and forecasts over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.operators import forecast as P
from tidemark.operators import metrics as M
from tidemark.plans import substrate as S
from tidemark.plans.catalog import query, r6, s6
from tidemark.plans.kernel_queries import BB, GP, Z

AXES = """, wk AS (SELECT DISTINCT week FROM post), dense AS (SELECT week, n_nationkey AS genre FROM wk, nation),
    pm AS (SELECT week, genre, bool_and(likes IS NOT NULL) AS c FROM post LEFT JOIN eng USING (post_id) GROUP BY 1, 2),
    hd AS (SELECT DISTINCT week, genre, TRUE AS l FROM delta WHERE status = 'valid_weekly'),
    ax AS (SELECT week, genre, coalesce(c, FALSE) AS conversation_done, coalesce(l, FALSE) AS listening_done,
        week BETWEEN DATE '1995-06-05' AND DATE '1999-12-31' - 6 OR week BETWEEN DATE '2000-03-06' AND DATE '2001-02-25' - 6 AS supply_done
        FROM dense LEFT JOIN pm USING (week, genre) LEFT JOIN hd USING (week, genre))"""
STATE = "CASE WHEN NOT conversation_done THEN 'conversation_pending' WHEN NOT listening_done THEN 'listening_pending' WHEN NOT supply_done THEN 'supply_pending' ELSE 'complete' END"


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = S.posts(spark, sf_dir)
    own = posts.join(S.engagement(spark, sf_dir), "post_id", "left").select("week", "genre", F.col("likes").isNotNull().alias("mature"))
    windows = spark.createDataFrame([("1995-06-05", "1999-12-31"), ("2000-03-06", "2001-02-25")], "from string, to string").select(F.col("from").cast("date").alias("from"), F.col("to").cast("date").alias("to"))
    grid = M.dense(posts.select("week").distinct(), S.categories(spark, sf_dir).select("genre"))
    return M.axis_maturity(grid, own, S.deltas(spark, sf_dir), windows)


@query(S.sql("post eng delta", AXES + f" SELECT week, genre, conversation_done, listening_done, supply_done, {STATE} AS state FROM ax"))
def axis_maturity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes(spark, sf_dir).select("week", "genre", "conversation_done", "listening_done", "supply_done", "state")


@query("""SELECT DISTINCT week FROM (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week FROM lineitem)
    WHERE week BETWEEN DATE '1995-06-05' AND DATE '1999-12-31' - 6 OR week BETWEEN DATE '2000-03-06' AND DATE '2001-02-25' - 6""")
def supply_weeks_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = spark.createDataFrame([("1995-06-05", "1999-12-31"), ("2000-03-06", "2001-02-25")], "from string, to string")
    weeks = S.read(spark, sf_dir, "lineitem").select(S.week(F.col("l_shipdate")).alias("week")).distinct()
    return weeks.join(F.broadcast(windows), (F.col("from").cast("date") <= F.col("week")) & (F.col("to").cast("date") >= F.date_add("week", 6)), "left_semi")


INDEX = ", c2 AS (SELECT *, 2 * conv AS cc FROM grid)," + BB.format(pre="a", src="c2", c="cc", w="PARTITION BY week", p="b_", out="bo") + "," + GP.format(pre="g", src="bo", c="releases", w="PARTITION BY week", mean="avg(releases) OVER (PARTITION BY week)", p="s_", out="go") + f""",
    lg AS (SELECT *, ln(1 + b_post * b_t / 2) AS xc, ln(1 + listen) AS xl, ln(1 + s_post) AS xs FROM go),
    zz AS (SELECT *, {Z('xc', 'week')} AS zc, {Z('xl', 'week')} AS zl, {Z('xs', 'week')} AS zs FROM lg),
    ix AS (SELECT week, genre, family, conv, listen, releases, zc - avg(zc) OVER (PARTITION BY week) AS ci, zl - avg(zl) OVER (PARTITION BY week) AS li, zs - avg(zs) OVER (PARTITION BY week) AS si FROM zz)"""


@query(S.sql("grid", INDEX + f" SELECT week, genre, {s6('ci')} AS conversation_index, {s6('li')} AS listening_index, {s6('si')} AS supply_index FROM ix"))
def weekly_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.indices(S.grid(spark, sf_dir), ["week"])
    return df.select("week", "genre", *(r6(c).alias(c) for c in ("conversation_index", "listening_index", "supply_index")))


CLAIMS = INDEX + AXES + """, cl AS (SELECT ix.*, CASE WHEN st = 'complete' THEN (ci + li) / 2 END AS demand, CASE WHEN st = 'complete' THEN (ci + li) / 2 - si END AS opportunity,
    CASE WHEN st = 'complete' THEN li - ci END AS gap FROM ix JOIN (SELECT week, genre, """ + STATE + " AS st FROM ax) USING (week, genre))"


def claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.indices(S.grid(spark, sf_dir), ["week"]).join(axes(spark, sf_dir), ["week", "genre"])
    return M.claims(df, F.col("state") == "complete")


@query(S.sql("grid post eng delta", CLAIMS + f" SELECT week, genre, {s6('demand')} AS demand, {s6('opportunity')} AS opportunity, {s6('gap')} AS gap FROM cl"))
def decision_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claimed(spark, sf_dir).select("week", "genre", r6("demand").alias("demand"), r6("opportunity").alias("opportunity"), r6("gap").alias("gap"))


@query(S.sql("grid post eng delta", CLAIMS + f""", w AS (SELECT max(week) AS week FROM cl WHERE opportunity IS NOT NULL)
    SELECT week, genre, {s6('opportunity')} AS opportunity, CAST(row_number() OVER (ORDER BY opportunity DESC, genre) AS INTEGER) AS place FROM cl JOIN w USING (week) WHERE opportunity IS NOT NULL
    QUALIFY place <= 10"""))
def opportunity_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of the latest complete week."""
    df = claimed(spark, sf_dir).where("opportunity is not null")
    latest = df.agg(F.max("week").alias("week"))
    own = df.join(F.broadcast(latest), "week").select("week", "genre", "opportunity", F.row_number().over(Window.partitionBy("week").orderBy(F.col("opportunity").desc(), "genre")).alias("place"))
    return own.where("place <= 10").select("week", "genre", r6("opportunity").alias("opportunity"), "place")


@query(S.sql("grid", f""", x AS (SELECT week, genre, family, ln(1 + listen) AS x FROM grid), z AS (SELECT *, {Z('x', 'week')} AS a, {Z('x', 'week, family')} AS b FROM x)
    SELECT week, genre, 'global' AS context, 'listening' AS metric, {s6('a - avg(a) OVER (PARTITION BY week)')} AS value FROM z
    UNION ALL SELECT week, genre, 'peer_family', 'listening', {s6('b - avg(b) OVER (PARTITION BY week, family)')} FROM z"""))
def context_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listening in two comparison contexts, in long form."""
    df = S.grid(spark, sf_dir).withColumn("x", F.ln(1 + F.col("listen")))
    df = K.zscores(K.zscores(df, "x", ["week"], "listening"), "x", ["week", "family"], "listening_peer")
    return M.estimates(df, ["week", "genre"], ["listening", "listening_peer"]).select("week", "genre", "context", "metric", r6("value").alias("value"))


@query(S.sql("grid", f""", t AS (SELECT week, family, sum(conv) AS total, count(conv) AS members FROM grid WHERE listen IS NOT NULL GROUP BY 1, 2), z AS (SELECT *, {Z('ln(1 + total)', 'week')} AS z FROM t)
    SELECT week, family, {s6('total')} AS total, members, {s6('z - avg(z) OVER (PARTITION BY week)')} AS "index" FROM z"""))
def macro_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.families(S.grid(spark, sf_dir).withColumn("eligible", F.col("listen").isNotNull()), "conv")
    return df.select("week", "family", r6("total").alias("total"), "members", r6("index").alias("index"))


COVER = """, h AS (SELECT week, genre, conv, posts, listen, releases, count(*) OVER (PARTITION BY genre ORDER BY week RANGE BETWEEN INTERVAL 35 DAY PRECEDING AND CURRENT ROW) AS history FROM grid)"""
LADDER = """CASE WHEN genre = 24 THEN 'unsupported' WHEN history < 4 THEN 'collecting_history' WHEN listen IS NULL THEN 'insufficient_listening' WHEN posts < 2 THEN 'insufficient_conversation'
    WHEN releases IS NULL OR releases < 3 THEN 'insufficient_supply' ELSE 'ready' END"""


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.history(S.grid(spark, sf_dir), ["genre"], "week", 6)
    rules = [(F.col("genre") == 24, "unsupported"), (F.col("history") < 4, "collecting_history"), (F.col("listen").isNull(), "insufficient_listening"), (F.col("posts") < 2, "insufficient_conversation"), (F.col("releases").isNull() | (F.col("releases") < 3), "insufficient_supply")]
    return df.withColumn("state", M.eligibility(rules))


@query(S.sql("grid", COVER + f" SELECT week, genre, history, posts, {LADDER} AS state FROM h"))
def coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covered(spark, sf_dir).select("week", "genre", "history", "posts", "state")


@query(S.sql("grid", COVER + f" SELECT state, count(*) AS n FROM (SELECT {LADDER} AS state FROM h) GROUP BY state"))
def eligibility_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covered(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(S.sql("grid", COVER + f", e AS (SELECT max(week) AS eligible FROM (SELECT week, {LADDER} AS state FROM h) WHERE state = 'ready' AND week + 7 <= DATE '2001-06-01'), p AS (SELECT max(week) AS published FROM grid WHERE week < DATE '2001-01-01') SELECT eligible, published, eligible IS NOT NULL AND (published IS NULL OR eligible > published) AS promote FROM e, p"))
def promotion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = covered(spark, sf_dir).where("state = 'ready'")
    return M.promotion(ready, S.grid(spark, sf_dir).where("week < date'2001-01-01'"), F.lit("2001-06-01").cast("date"))


@query(S.sql("grid", ", x AS (SELECT genre, week, ln(1 + conv) AS x FROM grid) SELECT a.genre, a.week, " + s6("a.x") + " AS x, " + s6("b.x") + " AS x_lag_1, " + s6("c.x") + " AS x_lag_4, " + s6("d.x") + " AS x_lag_52 FROM x a LEFT JOIN x b ON b.genre = a.genre AND b.week = a.week - 7 LEFT JOIN x c ON c.genre = a.genre AND c.week = a.week - 28 LEFT JOIN x d ON d.genre = a.genre AND d.week = a.week - 364"))
def asof_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = P.lags(S.grid(spark, sf_dir).withColumn("x", F.ln(1 + F.col("conv"))), ["genre"], "week", "x", [1, 4, 52])
    return df.select("genre", "week", *(r6(c).alias(c) for c in ("x", "x_lag_1", "x_lag_4", "x_lag_52")))


BACK = """, x AS (SELECT genre, week, ln(1 + conv) AS x FROM grid),
    nv AS (SELECT a.genre, a.week AS origin, b.week AS target, a.x AS predicted, b.x AS actual FROM x a JOIN x b ON a.genre = b.genre AND b.week = a.week + 14),
    sn AS (SELECT b.genre, o.week AS origin, b.week AS target, a.x AS predicted, b.x AS actual FROM x o JOIN x b ON o.genre = b.genre AND b.week = o.week + 14 JOIN x a ON a.genre = b.genre AND a.week = b.week - 364)"""


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.grid(spark, sf_dir).select("genre", "week", F.ln(1 + F.col("conv")).alias("x"))


@query(S.sql("grid", BACK + " SELECT genre, " + s6("quantile_cont(actual - predicted, 0.1)") + " AS low, " + s6("quantile_cont(actual - predicted, 0.9)") + " AS high FROM nv GROUP BY genre"))
def naive_residual_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.residual_interval(P.naive(logged(spark, sf_dir), ["genre"], "week", "x", 2), ["genre"]).select("genre", r6("low").alias("low"), r6("high").alias("high"))


@query(S.sql("grid", BACK + f" SELECT genre, origin, target, {s6('predicted')} AS predicted, {s6('actual')} AS actual FROM sn"))
def seasonal_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.seasonal(logged(spark, sf_dir), ["genre"], "week", "x", 2).select("genre", "origin", "target", r6("predicted").alias("predicted"), r6("actual").alias("actual"))


SCORES = BACK + """, sc AS (SELECT genre, count(*) AS n, avg(abs(sn.actual - sn.predicted)) AS mae, avg(abs(nv.actual - nv.predicted)) AS m FROM sn JOIN nv USING (genre, origin, target) GROUP BY genre)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = logged(spark, sf_dir)
    return P.scores(P.seasonal(x, ["genre"], "week", "x", 2), P.naive(x, ["genre"], "week", "x", 2), ["genre"], ["genre", "origin", "target"])


@query(S.sql("grid", SCORES + f" SELECT genre, n, {s6('mae')} AS mae, {s6('CASE WHEN m > 1e-12 THEN mae / m END')} AS mase FROM sc"))
def backtest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("genre", "n", r6("mae").alias("mae"), r6("mase").alias("mase"))


@query(S.sql("grid", SCORES + " SELECT genre, CASE WHEN m > 1e-12 AND mae / m < 1 THEN 'seasonal' ELSE 'naive' END AS model, CASE WHEN m > 1e-12 AND mae / m < 1 THEN 'skill' ELSE 'no_skill' END AS status FROM sc"))
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.selected(scored(spark, sf_dir).withColumn("model", F.lit("seasonal")), ["genre"])


@query(S.sql("conv", ", t AS (SELECT genre, family, sum(conv) AS c FROM conv GROUP BY 1, 2), p AS (SELECT genre, row_number() OVER (PARTITION BY family ORDER BY c, genre) - 1 AS i, count(*) OVER (PARTITION BY family) AS n FROM t) SELECT genre, CASE WHEN n <= 1 THEN 'middle' WHEN i / CAST(n - 1 AS DOUBLE) <= 1.0 / 3 THEN 'low' WHEN i / CAST(n - 1 AS DOUBLE) >= 2.0 / 3 THEN 'high' ELSE 'middle' END AS tier FROM p"))
def popularity_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = S.conversation(spark, sf_dir).groupBy("genre", "family").agg(F.sum("conv").alias("c"))
    w = Window.partitionBy("family")
    return total.select("genre", P.tier(F.row_number().over(w.orderBy("c", "genre")) - 1, F.count(F.lit(1)).over(w)).alias("tier"))


@query(None)
def ets_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damped-trend forecasts of every category: no SQL; tested on series of known shape."""
    df = P.holt(logged(spark, sf_dir), ["genre"], "week", "x", 2)
    return df.select("genre", "origin", "target", *(r6(c).alias(c) for c in ("predicted", "low", "high")))


@query(S.sql("grid post eng delta", CLAIMS + f""", w AS (SELECT max(week) AS week FROM cl WHERE opportunity IS NOT NULL), f AS (SELECT cl.genre, a.ci AS last_ci, a.li AS last_li, opportunity, (a.ci + a.li) / 2 - si AS predicted FROM cl JOIN w USING (week) JOIN (SELECT genre, week, ci, li FROM ix) a ON a.genre = cl.genre AND a.week = cl.week - 7)
    SELECT genre, {s6('opportunity')} AS opportunity, {s6('predicted')} AS predicted, {s6('predicted - opportunity')} AS gain, CAST(row_number() OVER (ORDER BY predicted - opportunity DESC, genre) AS INTEGER) AS place FROM f WHERE predicted IS NOT NULL AND opportunity IS NOT NULL"""))
def next_up_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted opportunity (mean of both axes' persistence less supply) and its gain over the latest week's."""
    df = claimed(spark, sf_dir)
    latest = df.where("opportunity is not null").agg(F.max("week").alias("week"))
    now = df.join(F.broadcast(latest), "week").where("opportunity is not null").select("genre", "week", "opportunity", "supply_index")
    before = df.select("genre", F.date_add("week", 7).alias("week"), ((F.col("conversation_index") + F.col("listening_index")) / 2).alias("mean"))
    own = now.join(before, ["genre", "week"]).withColumn("predicted", F.col("mean") - F.col("supply_index")).where("predicted is not null").withColumn("gain", F.col("predicted") - F.col("opportunity"))
    place = F.row_number().over(Window.partitionBy("week").orderBy(F.col("gain").desc(), "genre"))
    return own.select("genre", r6("opportunity").alias("opportunity"), r6("predicted").alias("predicted"), r6("gain").alias("gain"), place.alias("place"))
