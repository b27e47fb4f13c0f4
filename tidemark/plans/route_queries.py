"""More routes of the read surface over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import reads as A
from tidemark.plans import backtest_queries as Q
from tidemark.plans import classify_queries as L
from tidemark.plans import compare_queries as P
from tidemark.plans import coverage_queries as C
from tidemark.plans import evidence_queries as V
from tidemark.plans import resolve_queries as R
from tidemark.plans import substrate as S
from tidemark.plans import version_queries as N
from tidemark.plans.catalog import ORACLES, query, r6, s6
from tidemark.plans.kernel_queries import Z


@query(C.COVERED + " SELECT genre, week, posts, releases, state FROM fin WHERE week = (SELECT max(week) FROM fin) ORDER BY genre LIMIT 100")
def read_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.coverage(C.covered(spark, sf_dir)).select("genre", "week", "posts", "releases", "state")


@query(S.sql("grid", Q.REC + f", f AS (SELECT * FROM rec WHERE axis = 'conversation' AND horizon = 2) SELECT genre, model, origin, target, {s6('predicted')} AS predicted, {s6('low')} AS low, {s6('high')} AS high FROM f WHERE origin = (SELECT max(origin) FROM f) ORDER BY genre, model LIMIT 100"))
def read_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.forecasts(Q.records(spark, sf_dir), axis="conversation", horizon=2)
    return own.select("genre", "model", "origin", "target", *(r6(c).alias(c) for c in ("predicted", "low", "high")))


@query(S.sql("grid", f""", t AS (SELECT week, family, sum(conv) AS total, count(conv) AS members FROM grid WHERE listen IS NOT NULL GROUP BY 1, 2), z AS (SELECT *, {Z('ln(1 + total)', 'week')} AS z FROM t),
    i AS (SELECT *, z - avg(z) OVER (PARTITION BY week) AS i FROM z) SELECT week, family, members, {s6('total')} AS total, {s6('i')} AS "index" FROM i QUALIFY row_number() OVER (PARTITION BY family ORDER BY week DESC) <= 26"""))
def read_macro_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.macro_families(M.families(S.grid(spark, sf_dir).withColumn("eligible", F.col("listen").isNotNull()), "conv"), weeks=26)
    return df.select("week", "family", "members", r6("total").alias("total"), r6("index").alias("index"))


@query(f"WITH f AS ({ORACLES['music_feed']}), c AS (SELECT * FROM f ORDER BY week DESC, likes DESC, post_id LIMIT 50) SELECT f.week, f.post_id, f.text, f.likes FROM f, (SELECT last(week ORDER BY week DESC, likes DESC, post_id) AS w, last(likes ORDER BY week DESC, likes DESC, post_id) AS l, last(post_id ORDER BY week DESC, likes DESC, post_id) AS p FROM c) WHERE (f.week < w OR f.week = w AND (f.likes < l OR f.likes = l AND f.post_id > p)) ORDER BY f.week DESC, f.likes DESC, f.post_id LIMIT 50")
def read_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's second page, by the cursor of the first: pages are the feature."""
    posts, asked = L.music_feed(spark, sf_dir), {"limit": 50}
    rows, more = A.has_more(A.feed(posts).collect(), 50)
    if not more:
        return posts.limit(0)
    last = rows[-1]
    after = A.resumed(A.token("feed", asked, [last.week, last.likes, last.post_id]), "feed", asked, 3)
    return A.feed(posts, after=after).limit(50)


@query(f"WITH e AS ({ORACLES['family_ecosystem']}) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY family ORDER BY week DESC) <= 12")
def read_ecosystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ecosystem(V.family_ecosystem(spark, sf_dir), weeks=12)


@query("SELECT n_regionkey AS family, count(*) AS members, list(n_nationkey ORDER BY n_name, n_nationkey) AS genres FROM nation GROUP BY n_regionkey")
def read_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.taxonomy(S.categories(spark, sf_dir))


@query(f"WITH u AS ({ORACLES['next_up_bounds']}) SELECT * FROM u WHERE origin = (SELECT max(origin) FROM u)")
def read_next_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.next_up(N.next_up_bounds(spark, sf_dir))


@query(f"WITH b AS ({ORACLES['brief_candidates']}), e AS ({ORACLES['brief_evidence']}), x AS (SELECT genre, list(kind || ':' || CAST(id AS VARCHAR) ORDER BY kind, score DESC, id) AS evidence FROM e GROUP BY genre) SELECT genre, week, listen, evidence FROM b LEFT JOIN x USING (genre) WHERE week = (SELECT max(week) FROM b)")
def read_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.briefs(R.brief_candidates(spark, sf_dir), P.brief_evidence(spark, sf_dir)).select("genre", "week", "listen", "evidence")


@query(S.sql("grid", ", m AS (SELECT genre, max(week) AS week FROM grid GROUP BY genre) SELECT k.genre, g.week, " + s6("g.conv") + " AS conv FROM (SELECT DISTINCT label AS genre FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL) k JOIN grid g ON g.genre = k.genre WHERE g.week = (SELECT max(week) FROM grid)"))
def read_scene_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's categories with the latest week's figures (their places have queries of their own)."""
    places = R.scene_projection(spark, sf_dir).withColumn("week", F.lit("2024-01-01").cast("date"))
    return A.scene(places, S.grid(spark, sf_dir).select("genre", "week", "conv")).select("genre", "week", r6("conv").alias("conv"))


@query(C.COVERED + " SELECT genre, week, posts, releases, state FROM fin WHERE genre = 3 ORDER BY week DESC LIMIT 52")
def read_coverage_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One category's latest weeks of coverage."""
    return C.covered(spark, sf_dir).where("genre = 3").orderBy(F.col("week").desc()).limit(52).select("genre", "week", "posts", "releases", "state")
