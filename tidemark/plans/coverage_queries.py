"""Coverage of categories from all sources, over the test tables.

Tags: lines by supplier; artists: customers as their orders show them; releases: parts, credited to their suppliers;
posts: orders; links and ambiguities: closed and open lines. Nation 24 is rejected; short aliases meet in four nations.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import coverage as C
from tidemark.plans import substrate as S
from tidemark.plans.catalog import query, r6, s6
from tidemark.sources.tables import settled

AS_OF, FLOOR = "1999-06-01 00:00:00", C.Thresholds(lookback_weeks=40, artists=3, valid_artists=1, posts=4, attempts=4, resolution_rate=0.4, overlap_artists=1, overlap_rate=0.01, max_age_days=240)
END = datetime.date(1999, 5, 31)


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    lines, orders = S.read(spark, sf_dir, "lineitem"), S.read(spark, sf_dir, "orders")
    nation, part = S.read(spark, sf_dir, "nation"), S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    customer = S.read(spark, sf_dir, "customer").join(nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    categories = S.categories(spark, sf_dir)
    fit = categories.where("genre <> 24")
    alias = lambda n: F.concat(F.lit("A"), (n % 23).cast("string"))
    labels = fit.select(F.col("name").alias("label"), "genre").unionByName(fit.select(alias(F.col("genre")).alias("label"), "genre"))
    name = lambda key: F.concat(F.lit(" Artist "), key.cast("string"))
    mbid = lambda key: F.when(key % 2 == 0, F.concat(F.lit("M"), key.cast("string")))
    tags = lines.select(alias(F.col("l_suppkey")).alias("tag"), F.col("l_shipdate").alias("at"))
    told = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    artists = told.select(name(F.col("c_custkey")).alias("name"), mbid(F.col("c_custkey")).alias("id"), F.array(F.col("n_name"), alias(F.col("c_custkey"))).alias("labels"), F.floor("o_totalprice").cast("long").alias("listeners"), F.col("o_orderkey").alias("plays"), F.col("o_orderdate").alias("at"))
    releases = lines.groupBy("l_partkey", "l_suppkey").agg(F.min("l_shipdate").alias("released"), F.max("l_shipdate").alias("at")).join(part, "l_partkey")
    releases = releases.select(F.col("l_partkey").alias("release"), "released", F.array(F.concat(F.lit("a"), F.col("p_size").cast("string"))).alias("labels"), name(F.col("l_suppkey")).alias("name"), mbid(F.col("l_suppkey")).alias("id"), "at")
    # both are read by several steps
    artists, releases = settled(artists, "artists")[0], settled(releases, "releases")[0]
    posts = orders.select(F.col("o_orderkey").alias("post"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("at"))
    link = lines.select(F.col("l_orderkey").alias("post"), name(F.col("l_suppkey")).alias("name"), mbid(F.col("l_suppkey")).alias("id"), F.when(F.col("l_returnflag") == "R", "mbid").otherwise("name").alias("kind"), F.col("l_quantity").alias("score"), F.col("l_shipdate").alias("at"), "l_linestatus")
    return categories, labels, {"tags": tags, "artists": artists, "releases": releases, "posts": posts, "links": link.where("l_linestatus = 'F'").drop("l_linestatus"), "ambiguities": link.where("l_linestatus <> 'F'").select("post", "name", "id", "at")}


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    categories, labels, found = sources(spark, sf_dir)
    return C.coverage(categories, labels, found, FLOOR, F.lit(AS_OF).cast("timestamp"), unfit=F.col("genre") == 24, end=END)


MONDAY = "CAST(date_trunc('week', {}) AS DATE)"
KEYED = "CASE WHEN {0} % 2 = 0 THEN 'id:m' || {0} ELSE 'name:artist ' || {0} END"
COVERED = f"""WITH lab AS (SELECT lower(n_name) AS alias, n_nationkey AS genre FROM nation WHERE n_nationkey <> 24 UNION SELECT 'a' || (n_nationkey % 23), n_nationkey FROM nation WHERE n_nationkey <> 24),
    idx AS (SELECT alias, min(genre) AS genre FROM lab GROUP BY alias HAVING count(DISTINCT genre) = 1),
    told AS (SELECT 'a' || (l_suppkey % 23) AS alias, {MONDAY.format('l_shipdate')} AS week, l_shipdate AS tm FROM lineitem),
    seen AS (SELECT {KEYED.format('c_custkey')} AS artist, 'name:artist ' || c_custkey AS name_key, {MONDAY.format('o_orderdate')} AS week, o_orderdate AS tm, CAST(floor(o_totalprice) AS BIGINT) AS listeners, o_orderkey AS plays, lower(n_name) AS l1, 'a' || (c_custkey % 23) AS l2
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey),
    last AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY artist, week ORDER BY tm DESC, plays DESC, listeners DESC) = 1),
    pair AS (SELECT *, coalesce(week - lag(week) OVER w = 7 AND listeners >= lag(listeners) OVER w AND plays >= lag(plays) OVER w, FALSE) AS grown FROM last WINDOW w AS (PARTITION BY artist ORDER BY week)),
    heard AS (SELECT DISTINCT genre, week, artist, name_key, tm, grown FROM (SELECT *, l1 AS alias FROM pair UNION ALL SELECT *, l2 FROM pair) JOIN idx USING (alias)),
    cred AS (SELECT l_partkey, l_suppkey, min(l_shipdate) AS released, max(l_shipdate) AS tm FROM lineitem GROUP BY 1, 2),
    iss AS (SELECT genre, {MONDAY.format('released')} AS week, l_partkey AS release, {KEYED.format('l_suppkey')} AS artist, 'name:artist ' || l_suppkey AS name_key, tm FROM cred JOIN part ON p_partkey = l_partkey JOIN idx ON alias = 'a' || p_size),
    mem AS (SELECT artist AS key, genre FROM heard UNION SELECT name_key, genre FROM heard UNION SELECT artist, genre FROM iss UNION SELECT name_key, genre FROM iss),
    lnk AS (SELECT l_orderkey AS post, l_suppkey, l_shipdate AS tm, l_returnflag = 'R' AS strong, l_quantity AS score, l_linestatus AS st FROM lineitem),
    best AS (SELECT * FROM lnk WHERE st = 'F' QUALIFY row_number() OVER (PARTITION BY post ORDER BY strong DESC, score DESC, tm DESC, ' Artist ' || l_suppkey) = 1),
    tri AS (SELECT post, l_suppkey, tm, TRUE AS done FROM best UNION ALL SELECT post, l_suppkey, tm, FALSE FROM lnk WHERE st <> 'F' AND post NOT IN (SELECT post FROM best)),
    kd AS (SELECT *, {KEYED.format('l_suppkey')} AS artist FROM tri),
    kk AS (SELECT *, CASE WHEN artist IN (SELECT key FROM mem) THEN artist ELSE 'name:artist ' || l_suppkey END AS key FROM kd),
    pl AS (SELECT genre, {MONDAY.format('o_orderdate')} AS week, post, artist, done, greatest(tm, o_orderdate) AS tm FROM kk JOIN orders ON o_orderkey = post JOIN mem USING (key)),
    ev AS (SELECT genre, week, 'tag' AS kind, alias AS item, NULL AS artist, tm FROM told JOIN idx USING (alias) UNION ALL SELECT genre, week, 'artist', artist, artist, tm FROM heard
        UNION ALL SELECT genre, week, 'valid', artist, NULL, tm FROM heard WHERE grown UNION ALL SELECT genre, week, 'release', CAST(release AS VARCHAR), artist, tm FROM iss
        UNION ALL SELECT genre, week, 'post', CAST(post AS VARCHAR), artist, tm FROM pl WHERE done UNION ALL SELECT genre, week, 'attempt', CAST(post AS VARCHAR), NULL, tm FROM pl),
    wks AS (SELECT week FROM told UNION SELECT week FROM seen UNION SELECT {MONDAY.format('released')} FROM cred),
    rng AS (SELECT CAST(unnest(generate_series(greatest((SELECT min(week) FROM wks), DATE '{END}' - {7 * (FLOOR.lookback_weeks - 1)}), DATE '{END}', INTERVAL 7 DAY)) AS DATE) AS week),
    cel AS (SELECT genre, week, {', '.join(f"nullif(count(DISTINCT CASE WHEN kind = '{k}' THEN item END), 0) AS {n}" for k, n in zip(('tag', 'artist', 'valid', 'release', 'post', 'attempt'), C.COUNTS, strict=True))}, max(tm) AS latest FROM ev GROUP BY 1, 2),
    fr AS (SELECT genre, week, artist, count(DISTINCT kind) AS n FROM ev WHERE kind IN ('artist', 'release', 'post') GROUP BY 1, 2, 3),
    ns AS (SELECT genre, week, count(DISTINCT kind) AS sources FROM ev WHERE kind IN ('artist', 'release', 'post') GROUP BY 1, 2),
    ov AS (SELECT genre, week, count(*) FILTER (WHERE n >= 2) AS overlap_artists, count(*) FILTER (WHERE n >= 2) / CAST(count(*) AS DOUBLE) AS overlap_rate FROM fr JOIN ns USING (genre, week) WHERE sources >= 2 GROUP BY 1, 2),
    cov AS (SELECT n_nationkey AS genre, n_regionkey AS family, rng.week, tags, artists, valid_artists, releases, posts, attempts, latest, overlap_artists, overlap_rate,
        (SELECT nullif(count(*), 0) FROM cel h WHERE h.genre = n_nationkey AND h.week <= rng.week AND (h.tags IS NOT NULL OR h.artists IS NOT NULL)) AS history,
        CASE WHEN attempts IS NOT NULL THEN coalesce(posts, 0) / CAST(attempts AS DOUBLE) END AS resolution_rate,
        coalesce(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(latest) > {FLOOR.max_age_days} * 86400000000, TRUE) AS stale
        FROM rng CROSS JOIN nation LEFT JOIN cel ON cel.genre = n_nationkey AND cel.week = rng.week LEFT JOIN ov ON ov.genre = n_nationkey AND ov.week = rng.week),
    fin AS (SELECT *, CASE WHEN genre = 24 OR stale THEN 'unsupported' WHEN valid_artists IS NULL AND history < {FLOOR.history} THEN 'collecting_history'
        WHEN tags IS NULL OR coalesce(artists, 0) < {FLOOR.artists} OR coalesce(valid_artists, 0) < {FLOOR.valid_artists} THEN 'insufficient_listening' WHEN coalesce(posts, 0) < {FLOOR.posts} THEN 'insufficient_conversation'
        WHEN coalesce(releases, 0) < {FLOOR.releases} THEN 'insufficient_supply' WHEN coalesce(attempts, 0) < {FLOOR.attempts} OR coalesce(resolution_rate, 0) < {FLOOR.resolution_rate} OR coalesce(overlap_artists, 0) < {FLOOR.overlap_artists} OR coalesce(overlap_rate, 0) < {FLOOR.overlap_rate} THEN 'insufficient_resolution' ELSE 'ready' END AS state FROM cov)"""


@query(COVERED + f" SELECT genre, family, week, tags, artists, valid_artists, releases, posts, attempts, history, {s6('resolution_rate')} AS resolution_rate, overlap_artists, {s6('overlap_rate')} AS overlap_rate, latest, stale, state FROM fin")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty weeks of every category: counts by source, history, resolution, overlap, age and the rung they stand on."""
    df = covered(spark, sf_dir)
    return df.select("genre", "family", "week", "tags", "artists", "valid_artists", "releases", "posts", "attempts", "history", r6("resolution_rate").alias("resolution_rate"), "overlap_artists", r6("overlap_rate").alias("overlap_rate"), "latest", "stale", "state")


@query(COVERED + " SELECT family, state, count(*) AS cells, CAST(sum(coalesce(posts, 0)) AS BIGINT) AS posts FROM fin GROUP BY family, state")
def coverage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covered(spark, sf_dir).groupBy("family", "state").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.coalesce("posts", F.lit(0))).alias("posts"))
