"""Names, aliases, sets, vectors of texts and hash trees over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import texts as T
from tidemark.operators import aliases as A
from tidemark.operators import embed as M
from tidemark.operators import evaluate as E
from tidemark.operators import versions as V
from tidemark.plans import substrate as S
from tidemark.plans.catalog import query, r6, s6

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
JSON = """'{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || ',"l_suppkey":' || l_suppkey || ',"l_returnflag":"' || l_returnflag || '","l_linestatus":"' || l_linestatus || '"}'"""


def tree_sql(source: str, name: str) -> str:
    """Leaves of 64 order numbers and two levels above."""
    lane = lambda i: f"CAST(sum(CAST(('0x' || substr(d, {8 * i + 1}, 8)) AS BIGINT)) AS VARCHAR)"
    up = lambda a, b: f"{b} AS (SELECT node // 16 AS node, CAST(sum(rows) AS BIGINT) AS rows, sha256(string_agg(CAST(node AS VARCHAR) || '=' || digest, ',' ORDER BY node)) AS digest FROM {a} GROUP BY 1)"
    return f"""{name}r AS (SELECT l_orderkey // 64 AS node, md5({JSON}) AS d FROM {source}),
    {name}0 AS (SELECT node, count(*) AS rows, sha256(CAST(node AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) || '/' || {" || ':' || ".join(lane(i) for i in range(4))}) AS digest FROM {name}r GROUP BY node),
    {up(f"{name}0", f"{name}1")}, {up(f"{name}1", f"{name}2")}"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "lineitem").select(*LINE)


def tree(df: DataFrame) -> DataFrame:
    return V.range_tree(df, F.floor(F.col("l_orderkey") / 64), LINE, levels=2)


@query("WITH " + tree_sql("lineitem", "t") + " " + " UNION ALL ".join(f"SELECT {i} AS level, node, rows, digest FROM t{i}" for i in range(3)))
def line_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash tree of lineitem over ranges of its orders."""
    return tree(lines(spark, sf_dir))


OTHER = "o AS (SELECT * REPLACE (CASE WHEN l_orderkey % 1000 = 7 THEN 'X' ELSE l_returnflag END AS l_returnflag) FROM lineitem WHERE l_orderkey // 64 % 50 <> 3)"


@query("WITH " + OTHER + ", " + tree_sql("lineitem", "t") + ", " + tree_sql("o", "u") + " SELECT coalesce(t0.node, u0.node) AS node, CASE WHEN u0.node IS NULL THEN 'added' WHEN t0.node IS NULL THEN 'removed' ELSE 'changed' END AS change FROM t0 FULL JOIN u0 ON t0.node = u0.node WHERE t0.digest IS DISTINCT FROM u0.digest")
def line_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of lineitem that differ from a copy with other flags in some orders and whole ranges missing."""
    own = lines(spark, sf_dir)
    other = own.where(F.floor(F.col("l_orderkey") / 64) % 50 != 3).withColumn("l_returnflag", F.when(F.col("l_orderkey") % 1000 == 7, "X").otherwise(F.col("l_returnflag")))
    return V.differing_ranges(tree(own), tree(other))


@query("""SELECT o_orderkey AS post_id, CAST(u.i AS INTEGER) AS place, u.name FROM (SELECT o_orderkey, unnest(CASE o_orderkey % 6
      WHEN 0 THEN [{'i': 1, 'name': n_name}] WHEN 1 THEN [{'i': 1, 'name': n_name}, {'i': 2, 'name': c_name}] WHEN 2 THEN [{'i': 1, 'name': n_name || ' and the Band of ' || n_name}]
      WHEN 3 THEN [{'i': 1, 'name': n_name}] WHEN 4 THEN [{'i': 1, 'name': c_mktsegment}, {'i': 2, 'name': n_name}] ELSE [] END) AS u
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)""")
def post_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in posts of six wordings, one for each order."""
    posts = S.read(spark, sf_dir, "orders").join(S.read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(S.read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    n, c, s, k = F.col("n_name"), F.col("c_name"), F.col("c_mktsegment"), F.col("o_orderkey") % 6
    text = F.concat
    of = F.when(k == 0, text(F.lit("still Listening  to "), n, F.lit(" again"))).when(k == 1, text(F.lit('"'), n, F.lit('," they say, and '), F.lit("“"), c, F.lit("” and \""), n, F.lit('"')))
    of = of.when(k == 2, text(F.lit("a new "), n, F.lit(" and the Band of "), n, F.lit(" album"))).when(k == 3, text(n, F.lit(" Just dropped, wow")))
    of = of.when(k == 4, text(F.lit("from '"), s, F.lit("': listening to "), n, F.lit("."))).otherwise(F.lit("don't, it's so \"x\" and 'y'"))
    return posts.select(F.col("o_orderkey").alias("post_id"), F.posexplode(T.candidate_names(of)).alias("place", "name")).withColumn("place", F.col("place") + 1)


KEYS = ["lang", "source", "long", "quality", "toxic", "labelled"]


@query(f"""WITH i AS (SELECT d.doc_id, d.lang, d.source, length(coalesce(text, '')) > 1000 AS long, quality, toxic, l.doc_id IS NOT NULL AS labelled, coalesce(text, '') AS t FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
    s AS (SELECT *, CAST(quality = 1 AS INTEGER) AS a1, CAST(toxic = 1 AS INTEGER) AS a2, CAST(contains(t, '.') AS INTEGER) AS p1, CAST(contains(t, '!') AS INTEGER) AS p2 FROM i),
    c AS (SELECT *, coalesce(a1, 0) * p1 + coalesce(a2, 0) * p2 AS tp, (1 - coalesce(a1, 0)) * p1 + (1 - coalesce(a2, 0)) * p2 AS fp, coalesce(a1, 0) * (1 - p1) + coalesce(a2, 0) * (1 - p2) AS fn FROM s)
    SELECT CAST(6 - grouping(lang) - grouping(source) - grouping(long) - grouping(quality) - grouping(toxic) - grouping(labelled) AS INTEGER) AS depth, lang, source, long, quality, toxic, labelled, count(*) AS items, count(*) FILTER (WHERE fp + fn = 0) AS exact,
      CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, {s6('sum(tp) / nullif(sum(tp) + sum(fp), 0)')} AS precision, {s6('sum(tp) / nullif(sum(tp) + sum(fn), 0)')} AS recall
    FROM c GROUP BY ROLLUP (lang, source, long, quality, toxic, labelled)""")
def set_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of two labels for each document, told from signs in its text, against the given ones: by six keys and roll-ups."""
    labels = S.read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = S.read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("t"))
    items = docs.join(labels.withColumn("labelled", F.lit(True)), "doc_id", "left").select("doc_id", "lang", "source", (F.length("t") > 1000).alias("long"), "quality", "toxic", F.coalesce("labelled", F.lit(False)).alias("labelled"))
    of = lambda df, *flags: df.select("doc_id", F.explode(F.array(*(F.when(c, n).otherwise(E.UNCLASSIFIED) for n, c in zip(("good", "toxic"), flags, strict=True)))).alias("label"))
    counts = E.counted_sets(items, of(docs, F.col("t").contains("."), F.col("t").contains("!")), of(labels, F.col("quality") == 1, F.col("toxic") == 1), "doc_id", "label")
    out = E.rolled_up(counts, KEYS)
    return out.withColumn("precision", r6("precision")).withColumn("recall", r6("recall"))


ALIASES = "WITH a AS (SELECT DISTINCT trim(lower(p_name)) AS folded, p_brand AS genre FROM part WHERE trim(lower(p_name)) <> ''), q AS (SELECT DISTINCT query, trim(lower(query)) AS q FROM (SELECT substr(c_name, 1, 9) AS query FROM customer UNION ALL SELECT substr(p_name, 1 + p_partkey % 4, 1 + p_partkey % 7) FROM part) WHERE trim(lower(query)) <> '')"


@query(ALIASES + " SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY CASE WHEN folded = q THEN 0 WHEN starts_with(folded, q) THEN 1 ELSE 2 END, length(folded), folded, genre) AS INTEGER) AS place, genre, folded FROM q JOIN a ON contains(folded, q) QUALIFY place <= 20")
def alias_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search inside all part names (aliases of their brands) for parts of names of all parts and customers."""
    part, customer = S.read(spark, sf_dir, "part"), S.read(spark, sf_dir, "customer")
    table = A.owned(part.select(F.col("p_brand").alias("genre"), F.col("p_type").alias("family"), F.col("p_name").alias("alias")))
    k = F.col("p_partkey")
    queries = customer.select(F.substring("c_name", 1, 9).alias("query")).unionByName(part.select(F.substr("p_name", (1 + k % 4).cast("int"), (1 + k % 7).cast("int")).alias("query")))
    return A.searched(queries, table)


@query("""WITH a AS (SELECT DISTINCT lower(c_mktsegment || ' ' || c_custkey % 40) AS folded, c_nationkey AS genre, n_regionkey AS family FROM customer JOIN nation ON n_nationkey = c_nationkey),
    o AS (SELECT *, count(*) OVER (PARTITION BY folded) AS owners, count(*) OVER (PARTITION BY folded, family) AS inside FROM a),
    q AS (SELECT DISTINCT c_mktsegment || ' ' || c_custkey % 50 AS name, CASE WHEN c_custkey % 3 > 0 THEN n_regionkey END AS family FROM customer JOIN nation ON n_nationkey = c_nationkey),
    f AS (SELECT q.name, q.family, max(owners) AS n, min(o.genre) AS one, min(CASE WHEN o.family = q.family AND inside = 1 THEN o.genre END) AS own FROM q LEFT JOIN o ON o.folded = lower(q.name) GROUP BY q.name, q.family)
    SELECT name, family, CASE WHEN n = 1 THEN one WHEN n > 1 THEN own END AS genre, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'alias' WHEN own IS NOT NULL THEN 'family' ELSE 'ambiguous' END AS method FROM f""")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that several categories own, resolved within the family that is asked for."""
    own = S.read(spark, sf_dir, "customer").join(S.read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    name = lambda n: F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % n).cast("string"))
    table = A.owned(own.select(F.col("c_nationkey").alias("genre"), F.col("n_regionkey").alias("family"), name(40).alias("alias")))
    asked = own.select(name(50).alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.col("n_regionkey")).alias("family"))
    return A.resolved(asked, table)


@query(f"""WITH w AS (SELECT conv_id, turn, role, unnest(string_split(text, ' ')) AS word FROM conversations WHERE text IS NOT NULL), h AS (SELECT conv_id, turn, role, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) AS n FROM w WHERE word <> ''),
    s AS (SELECT conv_id, turn, role, n % 16 AS i, sum(CASE WHEN n // 16 % 2 = 1 THEN 1.0 ELSE -1.0 END) AS x FROM h GROUP BY 1, 2, 3, 4), z AS (SELECT conv_id, turn, role, sqrt(sum(x * x)) AS z FROM s GROUP BY 1, 2, 3)
    SELECT s.conv_id, s.turn, s.role, CAST(i AS INTEGER) AS i, {s6('x / z')} AS x FROM s JOIN z USING (conv_id, turn, role) WHERE x <> 0""")
def embedded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all turns by the model without weights, as the components that are not 0."""
    out = M.embedded(S.read(spark, sf_dir, "conversations"), "text", arguments=(16,))
    return out.select("conv_id", "turn", "role", F.posexplode("embedding").alias("i", "x")).where("x <> 0").withColumn("x", r6("x"))
