"""Resolution, text rules, briefs and ledgers over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions import texts as T
from tidemark.operators import entities as N
from tidemark.operators import relational as R
from tidemark.operators import resolve as E
from tidemark.operators import scene as M
from tidemark.plans import substrate as S
from tidemark.plans.catalog import query, r6, s6
from tidemark.plans.relational_queries import MEMBERS, memberships

CENT = """, l AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings WHERE label IS NOT NULL),
    m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM l GROUP BY 1, 2), c AS (SELECT label AS genre, list(x ORDER BY i) AS centroid FROM m GROUP BY 1)"""
CENT = "WITH " + CENT.lstrip(", ")
COS = CENT + """, s AS (SELECT vec_id, genre, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) AS s FROM embeddings, c)"""


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.centroids(S.read(spark, sf_dir, "embeddings").where("label is not null"), "label", "embedding").withColumnRenamed("label", "genre")


@query(COS + f""", b AS (SELECT *, max(s) OVER (PARTITION BY vec_id) AS best FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, genre) AS r FROM b WHERE s >= 0.2 AND best - s <= 0.05)
    SELECT vec_id, genre, {s6('exp((s - best) / 0.1) / sum(exp((s - best) / 0.1)) OVER (PARTITION BY vec_id)')} AS weight, {s6('greatest(0, least(1, s))')} AS confidence FROM k WHERE r <= 3""")
def cosine_topk_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = E.embedded(S.read(spark, sf_dir, "embeddings"), _centroids(spark, sf_dir), key="vec_id", vector="embedding", floor=0.2)
    return own.select("vec_id", "genre", r6("weight").alias("weight"), r6("confidence").alias("confidence"))


@query(f"""WITH ev AS ({MEMBERS}), mp AS (SELECT n_nationkey AS tag, n_regionkey AS genre, 1.0 / (1 + n_nationkey % 3) + 0.013771 AS weight, 0.5 + n_nationkey / 100.0 AS confidence FROM nation WHERE n_nationkey % 4 <> 0),
    j AS (SELECT artist, m.genre, w * coalesce(weight, 1.0) AS s, confidence FROM ev LEFT JOIN mp m ON ev.genre = m.tag),
    k AS (SELECT *, bool_or(genre IS NOT NULL) OVER (PARTITION BY artist) AS resolved FROM j),
    g AS (SELECT artist, genre, CAST(sum(s) AS DOUBLE) AS t, sum(s * confidence) / sum(CASE WHEN TRUE THEN s END) AS c FROM k WHERE genre IS NOT NULL OR NOT resolved GROUP BY 1, 2)
    SELECT artist, genre, {s6('t / sum(t) OVER (PARTITION BY artist)')} AS weight, {s6('c')} AS confidence FROM g""")
def artist_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = memberships(spark, sf_dir).withColumnRenamed("genre", "tag")
    mp = S.read(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("tag"), F.col("n_regionkey").alias("genre"), (1.0 / (1 + F.col("n_nationkey") % 3) + 0.013771).alias("weight"), (0.5 + F.col("n_nationkey") / 100.0).alias("confidence"))
    return E.artist_memberships(ev, mp).select("artist", "genre", r6("weight").alias("weight"), r6("confidence").alias("confidence"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'fixed' WHEN p_size > 40 THEN lower(p_brand) WHEN p_size > 20 THEN lower(p_type) END AS value,
    CASE WHEN p_partkey % 50 = 0 THEN 'override' WHEN p_size > 40 THEN 'alias' WHEN p_size > 20 THEN 'similar' ELSE 'unresolved' END AS method FROM part""")
def resolution_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.read(spark, sf_dir, "part")
    steps = [("override", part.where("p_partkey % 50 = 0").select("p_partkey", F.lit("fixed").alias("value"))), ("alias", part.where("p_size > 40").select("p_partkey", F.lower("p_brand").alias("value"))), ("similar", part.where("p_size > 20").select("p_partkey", F.lower("p_type").alias("value")))]
    return E.ladder(part.select("p_partkey"), "p_partkey", steps)


@query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)
    SELECT page_id, host, host = 'example.org' OR host LIKE '%.example.org' OR host = 'example.net' OR host LIKE '%.example.net' AS known FROM h""")
def url_host_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.read(spark, sf_dir, "pages")
    return pages.select("page_id", T.host(F.col("url")).alias("host"), T.host_in(F.col("url"), ["example.org", "example.net"]).alias("known"))


RULES = {"quote": "\"", "list": "\\|", "shout": "[A-Z]{6,}", "digits": "[0-9]{4}", "ask": "\\?"}


@query("SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in RULES.items()) + "], lambda x: x IS NOT NULL) AS rules FROM documents")
def classifier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "documents").select("doc_id", T.fired({n: F.col("text").rlike(p) for n, p in RULES.items()}).alias("rules"))


@query("""SELECT doc_id FROM documents WHERE regexp_matches(text, '"') AND NOT regexp_matches(text, '[A-Z]{8,}') OR lang = 'fr' AND regexp_matches(text, '[0-9]{4}')""")
def feed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-trust rules, or a language with a pattern."""
    df = S.read(spark, sf_dir, "documents").select("doc_id", "lang", T.fired({"quote": F.col("text").rlike('"') & ~F.col("text").rlike("[A-Z]{8,}"), "year": F.col("text").rlike("[0-9]{4}")}).alias("rules"))
    trusted = F.coalesce(F.arrays_overlap("rules", F.array(F.lit("quote"))), F.lit(False))
    return df.where(trusted | ((F.col("lang") == "fr") & F.array_contains("rules", "year"))).select("doc_id")


@query(f"""WITH p AS (SELECT lang, source, regexp_matches(text, '[A-Z]{{6,}}|\\|') AS guess, quality = 0 AS truth FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT lang, count(*) FILTER (WHERE guess AND truth) AS tp, count(*) FILTER (WHERE guess AND NOT truth) AS fp, count(*) FILTER (WHERE NOT guess AND truth) AS fn FROM p GROUP BY lang)
    SELECT lang, tp, fp, fn, {s6('tp / nullif(CAST(tp + fp AS DOUBLE), 0)')} AS precision, {s6('tp / nullif(CAST(tp + fn AS DOUBLE), 0)')} AS recall FROM c""")
def pr_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.read(spark, sf_dir, "documents").join(S.read(spark, sf_dir, "labels"), "doc_id").select("lang", F.col("text").rlike("[A-Z]{6,}|\\|").alias("guess"), (F.col("quality") == 0).alias("truth"))
    own = E.agreement(df, ["lang"], "guess", "truth")
    return own.select("lang", "tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query(None)
def token_set_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the supplier whose alias scores best, 90 at least, or NULL: no SQL; tested on worked pairs."""
    customer = S.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    aliases = S.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.concat(F.lit("customer "), F.regexp_extract("s_name", "([0-9]+)$", 1)).alias("alias"))
    best = N.best_names(customer, aliases, least=90.0)
    return customer.hint("merge").join(best.hint("merge"), "name", "left").select("c_custkey", F.col("entity").alias("s_suppkey"), r6("score").alias("score"))


@query(None)
def unicode_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names between quotation marks, folded: no SQL; tested on worked texts."""
    names = S.read(spark, sf_dir, "documents").where(F.col("text").contains('"') | F.col("text").contains("“")).select("doc_id", F.explode(T.quoted_names("text")).alias("name"))
    return names.select("doc_id", "name", T.unicode_fold(F.col("name")).alias("folded"))


@query(CENT + f""", n AS (SELECT a.genre, b.genre AS other, list_cosine_similarity(a.centroid, b.centroid) AS s FROM c a JOIN c b ON a.genre <> b.genre)
    SELECT genre, other, {s6('s')} AS similarity FROM n WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY genre ORDER BY s DESC, other) <= 2""")
def crowded_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category's two nearest. Categories are the taxonomy: pairs of a bounded dimension."""
    c = _centroids(spark, sf_dir)
    other = c.select(F.col("genre").alias("other"), F.col("centroid").alias("theirs"))
    near = c.join(F.broadcast(other), F.col("genre") != F.col("other")).withColumn("similarity", K.cosine(F.col("centroid"), F.col("theirs"))).where("similarity > 0")
    return R.first_by(near, ["genre"], [F.col("similarity").desc(), F.col("other")], 2).select("genre", "other", r6("similarity").alias("similarity"))


TEMPLATES = ["Demand leads supply", "Supply has room", "Listeners are ahead", "An early signal"]


@query("SELECT n_nationkey, list_extract(" + str(TEMPLATES) + ", CAST(CAST(('0x' || substr(sha256(n_name), 1, 2)) AS INTEGER) % 4 + 1 AS INTEGER)) || ' in ' || n_name || ': ' || CASE WHEN n_nationkey >= 10 THEN '+' ELSE '' END || CAST(n_nationkey - 10 AS VARCHAR) || '.00' AS line FROM nation")
def template_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.format_string("%+.2f", (F.col("n_nationkey") - 10).cast("double"))
    return S.read(spark, sf_dir, "nation").select("n_nationkey", F.concat(T.pick(TEMPLATES, F.col("n_name")), F.lit(" in "), F.col("n_name"), F.lit(": "), sign).alias("line"))


@query(S.sql("grid", f""", d AS (SELECT *, ntile(10) OVER (PARTITION BY week ORDER BY listen DESC, genre) AS t FROM grid WHERE listen IS NOT NULL),
    h AS (SELECT d.genre, d.week, count(g.week) AS weeks, median(g.releases) AS mid FROM d LEFT JOIN grid g ON g.genre = d.genre AND g.week < d.week AND g.week >= d.week - 56 WHERE t = 1 GROUP BY 1, 2)
    SELECT d.genre, d.week, {s6('listen')} AS listen, h.weeks, {s6('mid')} AS mid FROM d JOIN h USING (genre, week) WHERE t = 1 AND (releases IS NULL OR mid IS NULL OR releases <= mid)"""))
def brief_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders of a week's listening whose supply is not above its own recent median."""
    grid = S.grid(spark, sf_dir)
    top = grid.where("listen is not null").withColumn("t", F.ntile(10).over(Window.partitionBy("week").orderBy(F.col("listen").desc(), "genre"))).where("t = 1")
    past = R.later_weeks(grid.select("genre", "week", F.col("week").alias("past"), F.col("releases").alias("r")), "week", 8)
    own = top.join(past, ["genre", "week"], "left").groupBy("genre", "week", "listen", "releases").agg(F.count("past").alias("weeks"), F.median("r").alias("mid"))
    return own.where("releases is null or mid is null or releases <= mid").select("genre", "week", r6("listen").alias("listen"), "weeks", r6("mid").alias("mid"))


LEDGER = """WITH a AS (SELECT lower(p_brand) AS tag, min(p_size) AS one FROM part WHERE p_partkey % 3 <> 0 AND p_size < 30 GROUP BY 1), b AS (SELECT lower(p_brand) AS tag, min(p_size) AS two FROM part WHERE p_partkey % 3 <> 1 AND p_size > 2 GROUP BY 1),
    l AS (SELECT coalesce(a.tag, b.tag) AS tag, one, two, CASE WHEN one IS NULL THEN 'added' WHEN two IS NULL THEN 'removed' WHEN one = two THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.tag = b.tag)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.read(spark, sf_dir, "part").withColumn("tag", F.lower("p_brand"))
    a = part.where("p_partkey % 3 <> 0 and p_size < 30").groupBy("tag").agg(F.min("p_size").alias("one"))
    b = part.where("p_partkey % 3 <> 1 and p_size > 2").groupBy("tag").agg(F.min("p_size").alias("two"))
    change = F.when(F.col("one").isNull(), "added").when(F.col("two").isNull(), "removed").when(F.col("one") == F.col("two"), "same").otherwise("changed")
    return a.join(b, "tag", "full").withColumn("change", change)


@query(LEDGER + " SELECT tag, one, two, change FROM l")
def mapping_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir)


@query(LEDGER + " SELECT count(*) FILTER (WHERE change = 'removed') = 0 AS nothing_lost, count(*) FILTER (WHERE change = 'changed') <= 0.5 * count(*) AS mostly_stable, count(*) > 10 AS large_enough FROM l")
def release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gate is false unless its condition is known to hold."""
    gate = lambda c: F.coalesce(c, F.lit(False))
    n = F.count(F.lit(1))
    return ledger(spark, sf_dir).agg(gate(F.count_if(F.col("change") == "removed") == 0).alias("nothing_lost"), gate(F.count_if(F.col("change") == "changed") <= 0.5 * n).alias("mostly_stable"), gate(n > 10).alias("large_enough"))


@query(None)
def scene_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories in two dimensions by principal components: no SQL; tested on vectors of known components."""
    return E.scene(_centroids(spark, sf_dir)).select("genre", r6("x").alias("x"), r6("y").alias("y"))


NEAR = """WITH v AS (SELECT vec_id AS genre, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    d AS (SELECT a.genre, b.genre AS other, greatest(1 - list_cosine_similarity(a.e, b.e), 0) AS distance FROM v a JOIN v b ON a.genre <> b.genre)
    SELECT genre, CAST(row_number() OVER (PARTITION BY genre ORDER BY distance, other) AS INTEGER) AS rank, round(distance, 6) + 0.0 AS distance FROM d QUALIFY rank <= 15"""


@query(NEAR)
def scene_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scene map's graph over all vectors: each one's 15 nearest by cosine, by rank and distance."""
    near = M.neighbours(S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("genre"), "embedding"), "genre", "embedding", M.NEIGHBOURS)
    return near.select("genre", "rank", r6("distance").alias("distance"))


@query(None)
def scene_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories in two dimensions by their neighbours, with the latest week's conversation: no SQL; tested on planted
    clusters."""
    places = M.scene_map(_centroids(spark, sf_dir))
    return M.with_latest(places, S.grid(spark, sf_dir), ["conv"]).select("genre", "week", r6("x").alias("x"), r6("y").alias("y"), r6("conv").alias("conv"))


@query("""WITH RECURSIVE t AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 1 THEN 99 WHEN n_nationkey = 7 THEN 7 WHEN n_nationkey IN (10, 11) THEN n_nationkey + 1 WHEN n_nationkey = 12 THEN 10 WHEN n_nationkey > 4 THEN n_regionkey END AS parent, CASE WHEN n_nationkey = 9 THEN 'NATION_8' ELSE 'NATION_' || n_nationkey END AS name FROM nation),
    up AS (SELECT id, parent AS top FROM t WHERE parent IS NOT NULL UNION SELECT up.id, t.parent FROM up JOIN t ON t.id = up.top WHERE t.parent IS NOT NULL),
    x AS (SELECT id FROM t GROUP BY id HAVING count(*) > 1), n AS (SELECT name FROM t GROUP BY name HAVING count(*) > 1)
    SELECT 'duplicate id' AS fault, CAST(id AS VARCHAR) AS id FROM x UNION ALL SELECT 'duplicate name', name FROM n
    UNION ALL SELECT 'missing parent', CAST(id AS VARCHAR) FROM t WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM t)
    UNION ALL SELECT 'cycle', CAST(id AS VARCHAR) FROM up WHERE id = top""")
def taxonomy_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a taxonomy with a missing parent, a name used twice, a category that is its own parent and a cycle of three."""
    k = F.col("n_nationkey")
    parent = F.when(k == 1, 99).when(k == 7, 7).when(k.isin(10, 11), k + 1).when(k == 12, 10).when(k > 4, F.col("n_regionkey"))
    name = F.when(k == 9, "NATION_8").otherwise(F.concat(F.lit("NATION_"), k.cast("string")))
    return E.taxonomy_faults(S.read(spark, sf_dir, "nation").select(k.alias("id"), parent.alias("parent"), name.alias("name")))
