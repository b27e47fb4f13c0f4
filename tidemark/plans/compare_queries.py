"""Comparison of versions, links to entities, collection plan, briefs and the demo table over the test tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.operators import compare as C
from tidemark.operators import demo as D
from tidemark.operators import entities as N
from tidemark.operators import forecast as P
from tidemark.operators import metrics as M
from tidemark.operators import relational as R
from tidemark.operators import resolve as E
from tidemark.plans import substrate as S
from tidemark.plans.catalog import query, r6, s6

VERSIONS = f""", one AS (SELECT week, genre, {s6('ln(1 + conv)')} AS x FROM conv WHERE genre <> 3), two AS (SELECT week, genre, CASE WHEN genre % 7 <> 2 THEN {s6('ln(1 + conv / posts)')} END AS x FROM conv WHERE posts > 1 OR genre < 5),
    l AS (SELECT coalesce(one.week, two.week) AS week, coalesce(one.genre, two.genre) AS genre, one.x AS one, two.x AS two,
        CASE WHEN one.week IS NULL THEN 'added' WHEN two.week IS NULL THEN 'removed' WHEN one.x IS NOT DISTINCT FROM two.x THEN 'same' WHEN one.x IS NULL THEN 'filled' WHEN two.x IS NULL THEN 'withheld' ELSE 'changed' END AS change
        FROM one FULL JOIN two ON one.week = two.week AND one.genre = two.genre)"""
RANKS = """, ra AS (SELECT week, genre, row_number() OVER (PARTITION BY week ORDER BY x DESC, genre) AS r FROM one WHERE x IS NOT NULL), rb AS (SELECT week, genre, row_number() OVER (PARTITION BY week ORDER BY x DESC, genre) AS r FROM two WHERE x IS NOT NULL),
    k AS (SELECT coalesce(ra.week, rb.week) AS week, coalesce(ra.genre, rb.genre) AS genre, ra.r AS one, rb.r AS two, ra.r - rb.r AS moved,
        CASE WHEN ra.r <= 5 AND rb.r <= 5 THEN 'stays' WHEN rb.r <= 5 THEN 'enters' WHEN ra.r <= 5 THEN 'leaves' END AS top
        FROM ra FULL JOIN rb ON ra.week = rb.week AND ra.genre = rb.genre)"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Totals of all categories but one, and means per post, some withheld, of the cells with several posts."""
    conv = S.conversation(spark, sf_dir)
    one = conv.where("genre <> 3").select("week", "genre", r6(F.ln(1 + F.col("conv"))).alias("x"))
    two = conv.where("posts > 1 or genre < 5").select("week", "genre", F.when(F.col("genre") % 7 != 2, r6(F.ln(1 + F.col("conv") / F.col("posts")))).alias("x"))
    return one, two


@query(S.sql("conv", VERSIONS + f" SELECT week, genre, one, two, {s6('two - one')} AS delta, change FROM l"))
def metric_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = C.ledger(*versions(spark, sf_dir), ["week", "genre"], "x")
    return own.select("week", "genre", "one", "two", r6(F.col("two") - F.col("one")).alias("delta"), "change")


@query(S.sql("conv", VERSIONS + RANKS + " SELECT week, genre, one, two, moved, top FROM k"))
def rank_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rank_ledger(*versions(spark, sf_dir), ["week"], "genre", "x", 5)


@query(S.sql("conv", VERSIONS + """, c AS (SELECT week, n_nationkey AS genre, n_regionkey AS family FROM (SELECT DISTINCT week FROM conv), nation)
    SELECT family, count(*) FILTER (WHERE a.x IS NOT NULL AND b.x IS NOT NULL) AS "both", count(*) FILTER (WHERE a.x IS NOT NULL AND b.x IS NULL) AS only_one,
        count(*) FILTER (WHERE a.x IS NULL AND b.x IS NOT NULL) AS only_two, count(*) FILTER (WHERE a.x IS NULL AND b.x IS NULL) AS neither
    FROM c LEFT JOIN one a USING (week, genre) LEFT JOIN two b USING (week, genre) GROUP BY family"""))
def missing_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    categories = S.categories(spark, sf_dir).select("genre", "family")
    cells = M.dense(S.conversation(spark, sf_dir).select("week").distinct(), categories)
    return C.missing_ledger(cells, *versions(spark, sf_dir), ["week", "genre"], "x", ["family"])


@query(S.sql("conv", f""", n AS (SELECT o.genre, o.week AS origin, t.week AS target, {s6('abs(t.conv - o.conv)')} AS e FROM conv o JOIN conv t ON t.genre = o.genre AND t.week = o.week + 14),
    s AS (SELECT o.genre, o.week AS origin, t.week AS target, {s6('abs(t.conv - p.conv)')} AS e FROM conv o JOIN conv p ON p.genre = o.genre AND p.week = o.week - 350 JOIN conv t ON t.genre = o.genre AND t.week = o.week + 14)
    SELECT coalesce(n.genre, s.genre) AS genre, coalesce(n.origin, s.origin) AS origin, coalesce(n.target, s.target) AS target, n.e AS error_one, s.e AS error_two,
        CASE WHEN n.e IS NULL OR s.e IS NULL THEN 'unpaired' WHEN n.e < s.e THEN 'one' WHEN s.e < n.e THEN 'two' ELSE 'tie' END AS better
    FROM n FULL JOIN s ON n.genre = s.genre AND n.origin = s.origin AND n.target = s.target"""))
def forecast_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence against the season before, two weeks ahead."""
    conv = S.conversation(spark, sf_dir)
    own = C.forecast_ledger(P.naive(conv, ["genre"], "week", "conv", 2), P.seasonal(conv, ["genre"], "week", "conv", 2), ["genre", "origin", "target"])
    return own.select("genre", "origin", "target", r6("error_one").alias("error_one"), r6("error_two").alias("error_two"), "better")


GATES = """, g AS (SELECT n_regionkey AS family, count(*) FILTER (WHERE change = 'removed') <= 0.6 * count(*) AS kept, count(*) FILTER (WHERE change = 'withheld') = 0 AS nothing_withheld,
        count(*) >= 100 AS large, max(abs(l.two - l.one)) < 5 AS bounded, quantile_cont(abs(moved), 0.5) <= 8 AS calm
        FROM l LEFT JOIN k ON k.week = l.week AND k.genre = l.genre JOIN nation ON n_nationkey = l.genre GROUP BY 1),
    f AS (SELECT family, coalesce(kept, FALSE) AS kept, coalesce(nothing_withheld, FALSE) AS nothing_withheld, coalesce(large, FALSE) AS large, coalesce(bounded, FALSE) AS bounded, coalesce(calm, FALSE) AS calm
        FROM (SELECT r_regionkey AS family FROM region UNION ALL SELECT 99) LEFT JOIN g USING (family)),
    p AS (SELECT *, kept AND nothing_withheld AND large AND bounded AND calm AS passed FROM f)"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of every family, and of one that has no rows and so must fail."""
    one, two = versions(spark, sf_dir)
    both = C.ledger(one, two, ["week", "genre"], "x").join(C.rank_ledger(one, two, ["week"], "genre", "x", 5).select("week", "genre", "moved"), ["week", "genre"], "left")
    own = both.join(S.categories(spark, sf_dir).select("genre", "family"), "genre")
    expected = S.read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("family")).unionAll(spark.range(99, 100).select(F.col("id").cast("int")))
    n, share = F.count(F.lit(1)), lambda state: F.count_if(F.col("change") == state)
    tests = {"kept": share("removed") <= 0.6 * n, "nothing_withheld": share("withheld") == 0, "large": n >= 100, "bounded": F.max(F.abs(F.col("two") - F.col("one"))) < 5, "calm": F.percentile(F.abs("moved"), F.lit(0.5)) <= 8}
    return C.gates(own, expected, "family", tests)


@query(S.sql("conv", VERSIONS + RANKS + GATES + " SELECT * FROM p"))
def family_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir)


@query(S.sql("conv", VERSIONS + RANKS + GATES + """, r AS (SELECT bool_and(passed) AS groups_pass, count(*) >= 5 AS all_families, count(*) FILTER (WHERE large) >= 3 AS mostly_large FROM p)
    SELECT *, groups_pass AND all_families AND mostly_large AS released FROM r"""))
def cutover_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.release(gated(spark, sf_dir), {"all_families": F.count(F.lit(1)) >= 5, "mostly_large": F.count_if("large") >= 3})


@query(f"""WITH p AS (SELECT lang, regexp_matches(text, '[A-Z]{{6,}}|\\|') AS guess, quality = 0 AS truth FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT lang, count(*) FILTER (WHERE guess AND truth) AS tp, count(*) FILTER (WHERE guess AND NOT truth) AS fp, count(*) FILTER (WHERE NOT guess AND truth) AS fn FROM p GROUP BY lang),
    q AS (SELECT *, tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS pr, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS re FROM c)
    SELECT lang, tp, fp, fn, {s6('pr')} AS precision, {s6('re')} AS recall, coalesce(tp + fp + fn >= 5 AND pr >= 0.6 AND re >= 0.5, FALSE) AS active FROM q""")
def family_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.read(spark, sf_dir, "documents").join(S.read(spark, sf_dir, "labels"), "doc_id").select("lang", F.col("text").rlike("[A-Z]{6,}|\\|").alias("guess"), (F.col("quality") == 0).alias("truth"))
    own = N.activation(E.agreement(df, ["lang"], "guess", "truth"), labels=5, precision=0.6, recall=0.5)
    return own.select("lang", "tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"), "active")


@query("""WITH t AS (SELECT l_orderkey AS post_id, max(l_shipdate) AS tried_at, bool_or(l_returnflag <> 'N') AS resolved, CASE WHEN bool_or(l_linestatus = 'F') THEN 'mbid' ELSE 'name' END AS kind FROM lineitem GROUP BY 1),
    u AS (SELECT max(l_shipdate) - INTERVAL 1500 DAY AS newest FROM lineitem)
    SELECT o_orderkey AS post_id FROM orders LEFT JOIN t ON post_id = o_orderkey CROSS JOIN u WHERE t.post_id IS NULL OR newest > tried_at AND (NOT resolved OR kind = 'name')""")
def pending_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.read(spark, sf_dir, "lineitem")
    tried = lines.groupBy(F.col("l_orderkey").alias("post_id")).agg(F.max("l_shipdate").alias("tried_at"), F.bool_or(F.col("l_returnflag") != "N").alias("resolved"), F.when(F.bool_or(F.col("l_linestatus") == "F"), "mbid").otherwise("name").alias("kind"))
    newest = lines.agg((F.max("l_shipdate") - F.expr("interval 1500 days")).alias("newest"))
    return N.pending(S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post_id")), tried, newest)


@query("""SELECT page_id, CASE WHEN lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) LIKE '%.example.org' OR lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) = 'example.org'
    THEN nullif(regexp_extract(url, '^[a-z]+://[^/?#]+/[a-z]{2}/([0-9]+)', 1), '') END AS entity FROM pages""")
def url_direct_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "pages").select("page_id", N.linked_path(F.col("url"), ["example.org"], "^/[a-z]{2}/([0-9]+)").alias("entity"))


@query(None)
def entity_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as posts, resolved by a direct link or by their names to the brands' best-known names: no SQL (the fuzzy
    ratio); tested on worked posts."""
    part = S.read(spark, sf_dir, "part")
    posts = part.select(F.col("p_partkey").alias("post_id"), F.when(F.col("p_partkey") % 10 == 0, F.lower("p_brand")).alias("direct"))
    names = part.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("post_id"), F.col("p_name").alias("name"))
    aliases = R.first_by(part, ["p_brand"], [F.col("p_size"), F.col("p_partkey")]).select(F.lower("p_brand").alias("entity"), F.concat(F.initcap("p_name"), F.lit("!")).alias("alias"))
    own = N.resolved_posts(posts, names, aliases)
    return own.select("post_id", "entity", "method", r6("score").alias("score"), "outcome")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), p AS (SELECT source, n, CAST(ceil(n / 25.0) AS BIGINT) AS requests FROM c),
    s AS (SELECT *, CAST(ceil(requests / 4.0) AS BIGINT) AS seconds FROM p)
    SELECT coalesce(source, '') AS source, n, requests, seconds, greatest(1, least(16, CAST(ceil(seconds / 2.0) AS BIGINT))) AS shards, sha256(coalesce(source, '') || ':' || n || ':' || requests) AS plan FROM s""")
def collection_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of 25 rows at 4 a second, shards of 2 seconds and at most 16, and the plan's fingerprint."""
    own = S.read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("source", F.lit("")).alias("source"), "n", F.ceil(F.col("n") / 25).alias("requests"))
    own = own.withColumn("seconds", F.ceil(F.col("requests") / 4))
    shards = F.greatest(F.lit(1).cast("long"), F.least(F.lit(16).cast("long"), F.ceil(F.col("seconds") / 2)))
    return own.select("source", "n", "requests", "seconds", shards.alias("shards"), F.sha2(F.concat_ws(":", "source", "n", "requests"), 256).alias("plan"))


@query(S.sql("grid", """SELECT CASE WHEN listen IS NULL THEN 'no_listening' WHEN releases IS NULL THEN 'no_supply' WHEN posts < 2 THEN 'thin_conversation' WHEN conv < 100 THEN 'weak_conversation' ELSE 'ready' END AS reason,
    count(*) AS cells, count(DISTINCT genre) AS genres FROM grid GROUP BY 1"""))
def brief_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by the first rule that keeps a brief from being written."""
    reason = M.eligibility([(F.col("listen").isNull(), "no_listening"), (F.col("releases").isNull(), "no_supply"), (F.col("posts") < 2, "thin_conversation"), (F.col("conv") < 100, "weak_conversation")])
    return S.grid(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("genre").alias("genres"))


@query(S.sql("post eng", """, a AS (SELECT genre, 'author' AS kind, author AS id, CAST(count(*) AS DOUBLE) AS score FROM post GROUP BY genre, author QUALIFY row_number() OVER (PARTITION BY genre ORDER BY count(*) DESC, author) <= 3),
    p AS (SELECT genre, 'post' AS kind, post_id AS id, CAST(likes AS DOUBLE) AS score FROM post JOIN eng USING (post_id) QUALIFY row_number() OVER (PARTITION BY genre ORDER BY likes DESC, post_id) <= 1),
    r AS (SELECT s_nationkey AS genre, 'release' AS kind, l_partkey AS id, sum(l_quantity) AS score FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 3 QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY sum(l_quantity) DESC, l_partkey) <= 2)
    SELECT * FROM a UNION ALL SELECT * FROM p UNION ALL SELECT * FROM r"""))
def brief_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category's three authors, one post and two releases: one ranked query a kind."""
    posts = S.posts(spark, sf_dir)
    kinds = {
        "author": (posts.groupBy("genre", F.col("author").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("score")), 3),
        "post": (posts.join(S.engagement(spark, sf_dir), "post_id").select("genre", F.col("post_id").alias("id"), F.col("likes").cast("double").alias("score")), 1),
        "release": (S.read(spark, sf_dir, "lineitem").join(S.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("genre")), "l_suppkey").groupBy("genre", F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("score")), 2),
    }
    parts = [R.first_by(df, ["genre"], [F.col("score").desc(), F.col("id")], n).select("genre", F.lit(kind).alias("kind"), "id", "score") for kind, (df, n) in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(S.sql("conv", f""", k AS (SELECT genre, family, week, conv, week - CAST(row_number() OVER (PARTITION BY genre ORDER BY week) * 7 AS INTEGER) AS k FROM conv),
    r AS (SELECT *, row_number() OVER (PARTITION BY genre, k ORDER BY week) AS run FROM k)
    SELECT r.genre, r.week AS origin, t.week AS target, run, {s6('r.conv')} AS x_lag_0, {s6('a.conv')} AS x_lag_1, {s6('b.conv')} AS x_lag_3, {s6('t.conv')} AS y
    FROM r JOIN conv t ON t.genre = r.genre AND t.week = r.week + 7 LEFT JOIN conv a ON a.genre = r.genre AND a.week = r.week - 7 LEFT JOIN conv b ON b.genre = r.genre AND b.week = r.week - 21
    WHERE run >= 4 AND t.week <= DATE '2000-06-05'"""))
def training_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples one week ahead with targets up to the cutoff and at least four unbroken weeks at their origin."""
    conv = S.conversation(spark, sf_dir).select("genre", "week", F.col("conv").alias("x"))
    own = P.lags(K.islands(conv, ["genre"], "week", "first"), ["genre"], "week", "x", [0, 1, 3]).withColumn("run", (F.datediff("week", "first") / 7 + 1).cast("long"))
    target = conv.select("genre", F.date_sub("week", 7).alias("week"), F.col("week").alias("target"), F.col("x").alias("y"))
    own = own.join(target, ["genre", "week"]).where((F.col("run") >= 4) & (F.col("target") <= F.lit("2000-06-05").cast("date")))
    return own.select("genre", F.col("week").alias("origin"), "target", "run", *(r6(c).alias(c) for c in ("x_lag_0", "x_lag_1", "x_lag_3", "y")))


DEMO = f"""WITH p AS ({S.SQL['post']}), c AS (SELECT DISTINCT week, genre FROM p), i AS (SELECT week, genre, (week - min(week) OVER ()) // 7 AS i FROM c)
    SELECT week, genre, {s6('50 + 3 * genre + 0.25 * CAST(i AS DOUBLE) + 10 * sin(i / 4.0::DOUBLE + genre)')} AS conv, {s6('400 + 20 * genre + 2 * CAST(i AS DOUBLE) + 80 * cos(i / 6.0::DOUBLE + genre / 2.0::DOUBLE)')} AS listen,
    CAST(floor(6 + 5 * sin(CAST(i AS DOUBLE) * (2 * pi() / 52) + genre) ** 2) AS BIGINT) AS releases FROM i"""


def demo(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells = S.posts(spark, sf_dir).select("week", "genre").distinct()
    return cells, D.weekly(cells)


@query(DEMO)
def demo_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic readings for every week and category that has orders."""
    return demo(spark, sf_dir)[1].select("week", "genre", r6("conv").alias("conv"), r6("listen").alias("listen"), "releases")


@query(f"WITH d AS ({DEMO}) SELECT abs(count(*) - (SELECT count(*) FROM (SELECT DISTINCT week, genre FROM ({S.SQL['post']})))) AS wrong_rows, count(*) - count(DISTINCT (week, genre)) AS repeated, count(*) FILTER (WHERE coalesce(conv < 0 OR listen < 0 OR releases < 0, TRUE)) AS bad_values, count(*) FILTER (WHERE isodow(week) <> 1) AS not_mondays FROM d")
def demo_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, df = demo(spark, sf_dir)
    return D.faults(df, cells.count(), ["conv", "listen", "releases"])
