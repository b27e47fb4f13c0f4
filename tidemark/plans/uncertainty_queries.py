"""Uncertainty carried through every step: draws are shrunk and standardised like the points they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.operators import evidence as V
from tidemark.operators import metrics as M
from tidemark.plans import substrate as S
from tidemark.plans.catalog import query, r6, s6
from tidemark.sources.tables import settled
from tidemark.plans.kernel_queries import ALPHA, BB, EWMA_SQL, GP, Z, _recursive

DRAWS = 200
KEYS = ["week", "genre"]
AXES = ["conversation_index", "listening_index", "supply_index"]
CLAIMS = ["demand", "opportunity", "gap"]

POISSON = "CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5 ELSE 6 END"
UNIFORM = "CAST(('0x' || substr(md5(CAST({unit} AS VARCHAR) || ':' || CAST(k // 4 AS VARCHAR)), 1 + 8 * (k % 4), 8)) AS BIGINT) / 4294967296.0"


def drawn_sql(name: str, source: str, unit: str, weight: str) -> str:
    """A cell's sums in every draw."""
    u = UNIFORM.format(unit=unit)
    return f"{name} AS (SELECT week, genre, k, CAST(sum(w * {POISSON}) AS DOUBLE) AS v FROM (SELECT week, genre, k, {weight} AS w, {u} AS u FROM {source}, range({DRAWS}) r(k)) GROUP BY week, genre, k)"


def index_sql(source: str, out: str, by: str, tag: str) -> str:
    """The three indices of a grid, by week or by week and draw."""
    w, columns = f"PARTITION BY {by}", f"{by}, genre"
    z = lambda x: f"{Z(x, by)}"
    return (
        f"{tag}0 AS (SELECT *, 2 * conv AS cc FROM {source})," + BB.format(pre=f"{tag}a", src=f"{tag}0", c="cc", w=w, p="b_", out=f"{tag}b") + ","
        + GP.format(pre=f"{tag}g", src=f"{tag}b", c="releases", w=w, mean=f"avg(releases) OVER ({w})", p="s_", out=f"{tag}h") + f""",
    {tag}l AS (SELECT *, ln(1 + b_post * b_t / 2) AS xc, ln(1 + listen) AS xl, ln(1 + s_post) AS xs FROM {tag}h),
    {tag}z AS (SELECT *, {z("xc")} AS zc, {z("xl")} AS zl, {z("xs")} AS zs FROM {tag}l),
    {tag}i AS (SELECT {columns}, zc - avg(zc) OVER ({w}) AS conversation_index, zl - avg(zl) OVER ({w}) AS listening_index, zs - avg(zs) OVER ({w}) AS supply_index FROM {tag}z),
    {out} AS (SELECT *, (conversation_index + listening_index) / 2 AS demand, (conversation_index + listening_index) / 2 - supply_index AS opportunity, listening_index - conversation_index AS gap FROM {tag}i)"""
    )


UNITS = ", " + ", ".join([
    "pu AS (SELECT week, genre, post_id, 1 + 0.5 * likes + 1.5 * reposts + replies AS w FROM post JOIN eng USING (post_id))",
    "ru AS (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, s_nationkey AS genre, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)",
    drawn_sql("dc", "pu", "post_id", "w"),
    drawn_sql("dl", "(SELECT week, genre, segment, (plays - last_plays) + 5 * (listeners - last_listeners) AS gain FROM delta WHERE status = 'valid_weekly')", "strftime(week, '%Y-%m-%d') || '/' || genre || '/' || segment", "gain"),
    drawn_sql("dr", "ru", "strftime(week, '%Y-%m-%d') || '/' || genre || '/' || l_partkey", "1.0"),
    f"""gd AS (SELECT g.week, g.genre, k.k, coalesce(dc.v, 0) AS conv, CASE WHEN listen IS NOT NULL THEN coalesce(dl.v, 0) END AS listen, CASE WHEN releases IS NOT NULL THEN coalesce(dr.v, 0) END AS releases
        FROM grid g CROSS JOIN range({DRAWS}) k(k) LEFT JOIN dc ON dc.week = g.week AND dc.genre = g.genre AND dc.k = k.k LEFT JOIN dl ON dl.week = g.week AND dl.genre = g.genre AND dl.k = k.k
        LEFT JOIN dr ON dr.week = g.week AND dr.genre = g.genre AND dr.k = k.k)""",
    index_sql("grid", "ip", "week", "p"),
    index_sql("gd", "dp", "week, k", "q"),
])


def bands_sql(points: str, draws: str, names: list[str]) -> str:
    """Points with the quantiles of their draws, widened to hold them."""
    parts = [f"""SELECT week, genre, '{n}' AS metric, {s6(f'any_value(p.{n})')} AS value, {s6(f'least(any_value(p.{n}), quantile_cont(d.{n}, 0.05))')} AS lower, {s6(f'greatest(any_value(p.{n}), quantile_cont(d.{n}, 0.95))')} AS upper
        FROM {points} p JOIN {draws} d USING (week, genre) WHERE p.{n} IS NOT NULL AND d.{n} IS NOT NULL GROUP BY week, genre""" for n in names]
    return " UNION ALL ".join(parts)


def grids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The grid, and the grid of every draw. Both read the same units, which are joined and made distinct once."""
    posts, _ = settled(S.scored(spark, sf_dir), "posts")
    pairs, _ = settled(S.deltas(spark, sf_dir).where("status = 'valid_weekly'"), "pairs")
    released, _ = settled(S.released(spark, sf_dir), "released")
    grid = S.summed(posts).join(S.gained(pairs), KEYS, "left").join(S.counted(released), KEYS, "left")
    grid, _ = settled(grid.select(*KEYS, "family", "conv", "listen", "releases"), "grid")
    named = lambda c: F.concat_ws("/", F.col("week").cast("string"), F.col("genre").cast("string"), F.col(c).cast("string"))
    cells = {
        "conv": M.resampled_sums(posts, KEYS, F.col("post_id"), F.col("score"), DRAWS),
        "listen": M.resampled_sums(pairs, KEYS, named("segment"), (F.col("plays") - F.col("last_plays")) + 5 * (F.col("listeners") - F.col("last_listeners")), DRAWS),
        "releases": M.resampled_sums(released, KEYS, named("l_partkey"), F.lit(1.0), DRAWS),
    }
    return grid, M.redrawn(cells, grid, KEYS, DRAWS)


def draws(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The grid's indices and claims, and those of every draw."""
    grid, drawn = grids(spark, sf_dir)
    claims = lambda df, by: M.claims(M.indices(df.drop("family"), by), F.lit(True))
    return claims(grid, ["week"]), claims(drawn, ["week", "k"])


def _rounded(bands: DataFrame) -> DataFrame:
    return bands.select(*KEYS, "metric", *(r6(c).alias(c) for c in ("value", "lower", "upper")))


@query(S.sql("grid post eng delta", UNITS + " " + bands_sql("ip", "dp", AXES)))
def bootstrap_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90 % bands of the three indices: every draw of posts, counters and releases is shrunk and standardised anew."""
    return _rounded(M.banded(*draws(spark, sf_dir), KEYS, AXES))


@query(S.sql("grid post eng delta", UNITS + " " + bands_sql("ip", "dp", CLAIMS)))
def bootstrap_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90 % bands of demand, opportunity and gap, draw by draw."""
    return _rounded(M.banded(*draws(spark, sf_dir), KEYS, CLAIMS))


TREND = EWMA_SQL.format(key="genre", nk="n.genre", x="opportunity", src="ip", a=ALPHA, on="n.genre = e.genre") + """,
    en AS (SELECT genre, k, week, opportunity AS x, row_number() OVER (PARTITION BY genre, k ORDER BY week) AS i FROM dp),
    ed AS (SELECT genre, k, week, i, x AS s, x AS o FROM en WHERE i = 1
        UNION ALL SELECT en.genre, en.k, en.week, en.i, CASE WHEN en.x IS NULL THEN ed.s WHEN ed.s IS NULL THEN en.x ELSE {a} * en.x + (1 - {a}) * ed.s END,
            CASE WHEN en.x IS NULL THEN NULL WHEN ed.s IS NULL THEN en.x ELSE {a} * en.x + (1 - {a}) * ed.s END
        FROM ed JOIN en ON en.genre = ed.genre AND en.k = ed.k AND en.i = ed.i + 1),
    ip2 AS (SELECT week, genre, o AS trend FROM e), dp2 AS (SELECT week, genre, k, o AS trend FROM ed)""".replace("{a}", ALPHA)


@query(_recursive(S.sql("grid post eng delta", UNITS + TREND + " " + bands_sql("ip2", "dp2", ["trend"]))))
def bootstrap_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90 % bands of opportunity's trend: the moving average is taken along every draw."""
    points, drawn = draws(spark, sf_dir)
    points, drawn = K.ewma(points, "opportunity", ["genre"], "week", out="trend"), K.ewma(drawn, "opportunity", ["genre", "k"], "week", out="trend")
    return _rounded(M.banded(points, drawn, KEYS, ["trend"]))


def context_sql(source: str, by: str, out: str, t: str) -> str:
    """The five metrics of a grid in both contexts, by week or by week and draw; t begins the names of the steps."""
    on = f"USING ({by}, family)"
    w, ww = f"PARTITION BY {by}", f"PARTITION BY {by}, family"
    same = " AND ".join(f"{t}vs.{c} = {t}vw.{c}" for c in [*by.split(", "), "genre"])
    columns = lambda x: ", ".join(f"{x}.{c}" for c in by.split(", "))
    return (
        f"{t}el AS (SELECT {by}, genre, family, conv, 2 * conv AS c2, listen, releases FROM {source} WHERE listen IS NOT NULL AND releases IS NOT NULL), {t}fc AS (SELECT {by}, family, sum(c2) AS f FROM {t}el GROUP BY {by}, family),"
        + BB.format(pre=f"{t}va", src=f"{t}fc", c="f", w=w, p="f_", out=f"{t}vf") + "," + BB.format(pre=f"{t}vb", src=f"{t}el", c="c2", w=ww, p="w_", out=f"{t}vw")
        + f", {t}fs AS (SELECT {by}, family, avg(releases) AS f FROM {t}el GROUP BY {by}, family)," + GP.format(pre=f"{t}vg", src=f"{t}fs", c="f", w=w, mean=f"avg(f) OVER ({w})", p="g_", out=f"{t}vo")
        + f", {t}vj AS (SELECT {t}el.*, g_post FROM {t}el JOIN {t}vo {on})," + GP.format(pre=f"{t}vh", src=f"{t}vj", c="releases", w=ww, mean="g_post", p="h_", out=f"{t}vs")
        + f""", {t}vx AS (SELECT {columns(f"{t}vw")}, {t}vw.genre, {t}vw.family, ln(1 + f_post * w_post * sum({t}vw.c2) OVER (PARTITION BY {columns(f"{t}vw")}) / 2) AS xc, ln(1 + {t}vw.listen) AS xl, ln(1 + h_post) AS xs
        FROM {t}vw JOIN {t}vf {on} JOIN {t}vs ON {same}),"""
        + ", ".join(f"""{t}z{n} AS (SELECT {by}, genre, family, {", ".join(f"{Z(x, among)} AS {a}" for x, a in (("xc", "c"), ("xl", "l"), ("xs", "s")))} FROM {t}vx),
    {t}k{n} AS (SELECT {by}, genre, '{name}' AS context, CAST({scope} AS INTEGER) AS scope, c - avg(c) OVER (PARTITION BY {among}) AS conversation, l - avg(l) OVER (PARTITION BY {among}) AS listening, s - avg(s) OVER (PARTITION BY {among}) AS supply FROM {t}z{n})"""
            for n, name, scope, among in (("g", "global", "-1", by), ("p", "peer_family", "family", f"{by}, family")))
        + f", {out} AS (SELECT *, (conversation + listening) / 2 - supply AS opportunity, listening - conversation AS gap FROM (SELECT * FROM {t}kg UNION ALL SELECT * FROM {t}kp))"
    )


CONTEXT = ", " + context_sql("grid", "week", "kk", "") + """,
    lo AS (SELECT genre || '/' || context || '/' || metric AS key, genre, context, scope, metric, week, value FROM kk UNPIVOT (value FOR metric IN (conversation, listening, supply, opportunity, gap)))"""
FOLLOWED = EWMA_SQL.format(key="key", nk="n.key", x="value", src="lo", a=ALPHA, on="n.key = e.key") + """,
    rs AS (SELECT lo.*, e.o AS trend, lo.value - e.o AS r FROM lo JOIN e USING (key, week))"""


@query(_recursive(S.sql("grid", CONTEXT + FOLLOWED + f""" SELECT week, genre, context, metric, {s6('value')} AS value, {s6('trend')} AS trend,
    coalesce(count(r) OVER w >= 2 AND stddev_pop(r) OVER w > 1e-12 AND r > 2.5 * stddev_pop(r) OVER w, FALSE) AS spike FROM rs WINDOW w AS (PARTITION BY week, context, scope, metric)""")))
def estimates_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five metrics in two contexts with their trends and spikes, in long form."""
    df = M.followed(M.in_contexts(S.grid(spark, sf_dir)))
    return df.select("week", "genre", "context", "metric", r6("value").alias("value"), r6("trend").alias("trend"), "spike")


@query(S.sql("grid", CONTEXT + """, th AS (SELECT week, context, scope, quantile_cont(listening, 0.9) AS hi, median(conversation) AS mid FROM kk GROUP BY 1, 2, 3)
    SELECT week, genre, context, listening >= hi AND conversation < mid AS breakout FROM kk JOIN th USING (week, context, scope)"""))
def context_breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakouts among all categories and among those of a family."""
    return M.breakouts_in_contexts(M.in_contexts(S.grid(spark, sf_dir)))


def context_bands_sql(points: str, drawn: str) -> str:
    return " UNION ALL ".join(f"""SELECT week, genre, context, '{m}' AS metric, {s6(f'any_value(p.{m})')} AS value, {s6(f'least(any_value(p.{m}), quantile_cont(d.{m}, 0.05))')} AS lower, {s6(f'greatest(any_value(p.{m}), quantile_cont(d.{m}, 0.95))')} AS upper
        FROM {points} p JOIN {drawn} d USING (week, genre, context) WHERE p.{m} IS NOT NULL GROUP BY week, genre, context""" for m in M.METRICS)


def _in_contexts(bands: DataFrame) -> DataFrame:
    return bands.select("week", "genre", "context", "metric", *(r6(c).alias(c) for c in ("value", "lower", "upper")))


#: The draws' grid with families, as the queries below shrink within them.
FAMILIES = ", fg AS (SELECT gd.*, n_regionkey AS family FROM gd JOIN nation ON n_nationkey = genre)"


@query(S.sql("grid post eng delta", UNITS + FAMILIES + ", " + context_sql("grid", "week", "kk", "") + ", " + context_sql("fg", "week, k", "kd", "d_") + " " + context_bands_sql("kk", "kd")))
def estimates_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five metrics in both contexts with 90 % bands: every draw is shrunk and standardised anew, among all categories and
    among those of the family."""
    return _in_contexts(M.banded_contexts(*grids(spark, sf_dir)))


MACRO = "{out} AS (SELECT {by}, family AS genre, family, sum(conv) AS conv, sum(listen) AS listen, sum(releases) AS releases FROM {source} WHERE listen IS NOT NULL AND releases IS NOT NULL GROUP BY {by}, family)"


@query(S.sql("grid post eng delta", UNITS + FAMILIES + ", " + MACRO.format(out="mg", by="week", source="grid") + ", " + MACRO.format(out="md", by="week, k", source="fg") + ", " + context_sql("mg", "week", "kk", "") + ", " + context_sql("md", "week, k", "kd", "d_")
    + " SELECT * FROM (" + context_bands_sql("kk", "kd") + ") WHERE context = 'global'"))
def macro_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of whole families, compared with each other."""
    grid, drawn = grids(spark, sf_dir)
    return _in_contexts(M.banded_contexts(M.macro_scopes(grid), M.macro_scopes(drawn, ["week", "k"])).where("context = 'global'"))


def ecosystem_sql(source: str, by: str, t: str) -> str:
    return f"""{t}p AS (SELECT {by}, coalesce(conv / nullif(sum(conv) OVER w, 0), 0) AS p, row_number() OVER (PARTITION BY {by} ORDER BY conv DESC, genre) AS r FROM {source} WHERE conv IS NOT NULL WINDOW w AS (PARTITION BY {by})),
    {t}e AS (SELECT {by}, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS entropy, sum(p * p) AS hhi, sum(CASE WHEN r <= 3 THEN p ELSE 0 END) AS top_share FROM {t}p GROUP BY {by})"""


def ecosystem_bands_sql(points: str, drawn: str, by: str, scope: str) -> str:
    return " UNION ALL ".join(f"""SELECT week, {scope} AS family, '{m}' AS measure, {s6(f'any_value(p.{m}) + 1e-9')} AS value, {s6(f'least(any_value(p.{m}), quantile_cont(d.{m}, 0.05)) + 1e-9')} AS lower, {s6(f'greatest(any_value(p.{m}), quantile_cont(d.{m}, 0.95)) + 1e-9')} AS upper
        FROM {points} p JOIN {drawn} d USING ({by}) GROUP BY {by}""" for m in V.CONCENTRATION)


@query(S.sql("grid post eng delta", UNITS + FAMILIES + ", " + ", ".join(ecosystem_sql(source, by, t) for source, by, t in (("grid", "week", "ea"), ("fg", "week, k", "eb"), ("grid", "week, family", "ec"), ("fg", "week, family, k", "ed")))
    + " " + ecosystem_bands_sql("eae", "ebe", "week", "CAST(NULL AS INTEGER)") + " UNION ALL " + ecosystem_bands_sql("ece", "ede", "week, family", "family")))
def ecosystem_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy, concentration and the three largest categories' share of every week's conversation with 90 % bands, among all
    categories and within each family."""
    grid, drawn = grids(spark, sf_dir)
    drawn, _ = settled(drawn.select("week", "genre", "family", "k", "conv"), "drawn")
    whole = V.banded_ecosystem(grid, drawn, "conv", 3).select("week", F.lit(None).cast("int").alias("family"), "measure", "value", "lower", "upper")
    out = whole.unionByName(V.banded_ecosystem(grid, drawn, "conv", 3, "family"))
    # shares of few posts often end in a 5 at the seventh place, which engines round by their last bits: both are put above it
    return out.select("week", "family", "measure", *(r6(F.col(c) + 1e-9).alias(c) for c in ("value", "lower", "upper")))
