"""The music classifier and the feed over posts written from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import classify as C
from tidemark.operators import relational as R
from tidemark.plans import substrate as S
from tidemark.plans.catalog import query

#: Texts and links that posts are written from, in turn.
TEXTS = [
    "Listening to The National again", "so much on repeat today", "listening to nothing in particular", "Their new album is out", "A new EP, a new single", "I am a new single and dating again",
    "It just dropped, go", "He just dropped the ball", "no problem, anytime #np", "Low - Words #np", "#np and #music for you", "#NowPlaying: a song", "a video of a song I like", "a video of a cat", "mail#newmusic is no tag", "plain words",
]
LINKS = ["https://artist.bandcamp.com/album/x", "https://www.youtube.com/watch?v=1", "http://youtu.be/2", "https://open.spotify.com./track/3", "https://notbandcamp.com/x", "no url", "https://NHL.com]", "https://LAST.FM/music/a"]


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(post_id, week, text, links, given): every order is a post; customers' numbers choose the wording."""
    one = lambda options, n: F.element_at(F.array(*map(F.lit, options)), (n % len(options) + 1).cast("int"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    links = F.when(c % 3 == 0, F.array(one(LINKS, k), one(LINKS, k + c))).otherwise(F.array().cast("array<string>"))
    given = F.when(k % 11 == 0, F.array(F.lit("#NewRelease"), F.lit("")))
    # few splits of a compressed file hold millions of orders: they are dealt to all tasks before anything is matched
    orders = S.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition("o_orderkey")
    return orders.select(k.alias("post_id"), S.week(F.col("o_orderdate")).alias("week"), one(TEXTS, k + c).alias("text"), links.alias("links"), given.alias("given"))


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with their rules. A generated column is worked out once, behind the exchange; a plain one would be put into
    every filter and column that names it, and with them before the exchange."""
    found = C.rules(F.col("text"), F.col("links"), C.tags(F.col("text"), F.col("given")))
    return posts(spark, sf_dir).select("post_id", "week", "text", F.explode(F.array(found)).alias("rules"))


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''").replace("(?:", "(")


POSTS = f"""WITH p AS (SELECT o_orderkey AS post_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, list_extract({TEXTS!r}, CAST((o_orderkey + o_custkey) % {len(TEXTS)} + 1 AS INTEGER)) AS text,
        CASE WHEN o_custkey % 3 = 0 THEN [list_extract({LINKS!r}, CAST(o_orderkey % {len(LINKS)} + 1 AS INTEGER)), list_extract({LINKS!r}, CAST((o_orderkey + o_custkey) % {len(LINKS)} + 1 AS INTEGER))] ELSE [] END AS links,
        CASE WHEN o_orderkey % 11 = 0 THEN ['NewRelease'] ELSE [] END AS given FROM orders),
    t AS (SELECT *, list_concat(given, regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])#([A-Za-z0-9_]+)', 1)) AS tags,
        list_filter(list_transform(links, lambda u: CASE WHEN u LIKE '%]%' THEN NULL ELSE rtrim(lower(regexp_extract(u, '^[A-Za-z]+://([^/:?#]+)', 1)), '.') END), lambda h: h IS NOT NULL) AS hosts FROM p),
    r AS (SELECT post_id, week, text, list_concat(list_concat(
        list_filter(list_transform(hosts, lambda h: list_extract(list_filter({list(C.HOSTS)!r}, lambda a: h = a OR ends_with(h, '.' || a)), 1)), lambda x: x IS NOT NULL).list_transform(lambda x: 'link:' || x),
        list_filter(list_transform(tags, lambda x: lower(x)), lambda x: list_contains({list(C.TAGS)!r}, x)).list_transform(lambda x: 'hashtag:#' || x)),
        list_filter([{", ".join(f"CASE WHEN regexp_matches(text, '(?i){_sql(p)}') THEN '{n}' END" for n, p in C.WORDINGS.items())}], lambda x: x IS NOT NULL)) AS raw,
        [{", ".join(f"CASE WHEN regexp_matches(text, '(?i){_sql(p)}') THEN '{n}' END" for n, p in C.VETOES.items())}] AS veto FROM t),
    c AS (SELECT post_id, week, text, list_filter(raw, lambda x: NOT coalesce(list_contains(veto, x), FALSE)) AS held FROM r)"""


@query(POSTS + " SELECT post_id, array_to_string(list_sort(list_distinct(held)), ' ') AS rules FROM c WHERE len(held) > 0")
def music_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of all posts that have some, sorted."""
    return ruled(spark, sf_dir).where(F.size("rules") > 0).select("post_id", F.array_join(F.array_sort("rules"), " ").alias("rules"))


FEED = f"""list_has_any(held, {list(C.TRUSTED)!r}) OR list_has_any(held, ['link:youtube.com', 'link:youtu.be']) AND regexp_matches(lower(text), '{C.VIDEO_WORDS}')
    OR list_contains(held, 'hashtag:#np') AND (regexp_matches(lower(text), '{C.TAGGED_MUSIC}') OR regexp_matches(text, '^[^\n]{{2,80}} - [^\n]{{2,80}}')) OR list_contains(held, 'intent:listening_to') AND regexp_matches(text, '{_sql(C.LISTENED)}')"""
ENGAGED = "SELECT l_orderkey AS post_id, max(l_linenumber) AS polled, arg_max(CAST(l_quantity AS BIGINT), struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey)) AS likes FROM lineitem GROUP BY 1"


@query(POSTS + f", e AS ({ENGAGED}) SELECT week, c.post_id, text, coalesce(likes, 0) AS likes FROM c LEFT JOIN e USING (post_id) WHERE {FEED}")
def music_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts that a feed shows, with their latest reading; 0 where there is none."""
    df = ruled(spark, sf_dir)
    lines = S.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("post_id"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("likes"))
    last = R.first_by(lines, ["post_id"], [F.col("l_linenumber").desc(), F.col("l_partkey").desc(), F.col("l_suppkey").desc()]).select("post_id", "likes").hint("merge")
    return df.where(C.in_feed(F.col("text"), F.col("rules"))).join(last, "post_id", "left").select("week", "post_id", "text", F.coalesce("likes", F.lit(0)).alias("likes"))
