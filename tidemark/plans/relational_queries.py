"""Relational operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.plans import substrate as S
from tidemark.plans.catalog import query, r6, s6


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.read(spark, sf_dir, "orders")
    return R.first_by(orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'A') DESC, l_quantity DESC, l_linenumber, l_partkey, l_suppkey) = 1""")
def preferred_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [(F.col("l_returnflag") == "A").desc(), F.col("l_quantity").desc(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return R.first_by(S.read(spark, sf_dir, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""SELECT CAST(c_custkey AS BIGINT) AS c_custkey, s_suppkey FROM customer JOIN supplier ON (c_custkey % 3 <> 0 AND c_custkey = s_suppkey)
    OR (c_custkey % 3 = 0 AND lower(trim(replace(c_name, 'Customer', 'Supplier'))) = lower(s_name))""")
def either_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = S.read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("lid"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("lname"))
    right = S.read(spark, sf_dir, "supplier")
    return R.either_key_join(left, right, left_id="lid", left_name="lname", right_id="s_suppkey", right_name="s_name").select("c_custkey", "s_suppkey")


HOURS = "(epoch_us(p.ts) - epoch_us(e.ts)) / 3600e6"
POLLS = f""", polls AS (SELECT e.event_id, max(CASE WHEN h BETWEEN 18 AND 36 THEN 1 ELSE 0 END) AS p24, max(CASE WHEN h BETWEEN 60 AND 84 THEN 1 ELSE 0 END) AS p72
        FROM (SELECT e.event_id, {HOURS} AS h FROM events e JOIN events p ON e.user_id = p.user_id AND p.ts > e.ts AND epoch_us(p.ts) - epoch_us(e.ts) <= 302400000000) e GROUP BY 1),
    aged AS (SELECT e.event_id, e.user_id, e.ts, (epoch_us(TIMESTAMP '2024-01-28 00:00:00') - epoch_us(e.ts)) / 3600e6 AS age, coalesce(p24, 0) AS p24, coalesce(p72, 0) AS p72
        FROM events e LEFT JOIN polls USING (event_id) WHERE e.event_type <> 'view')"""
POLLS = "WITH " + POLLS.lstrip(", ")


HOUR = 3_600_000_000


def polled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their age at a fixed time, and whether the same user had later events in the 24 h and 72 h windows."""
    events = S.read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    own = Window.partitionBy("user_id").orderBy(F.unix_micros("ts"))
    has = lambda a, b: (F.count(F.lit(1)).over(own.rangeBetween(a * HOUR, b * HOUR)) > 0).cast("int")
    age = R.hours_between(F.col("ts"), F.lit("2024-01-28 00:00:00").cast("timestamp"))
    out = events.select("event_id", "user_id", "ts", "event_type", age.alias("age"), has(18, 36).alias("p24"), has(60, 84).alias("p72"))
    return out.where("event_type <> 'view'").drop("event_type")


STATUS = """CASE WHEN p72 = 1 THEN 'complete' WHEN p24 = 0 AND age < 36 THEN 'awaiting_24h' WHEN p24 = 0 AND age < 60 THEN 'overdue_24h' WHEN age < 84 THEN 'awaiting_72h' ELSE 'overdue_72h' END"""


@query(POLLS + f" SELECT event_id, {STATUS} AS status FROM aged WHERE age >= 0")
def maturity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polled(spark, sf_dir).where("age >= 0").select("event_id", F.expr(STATUS).alias("status"))


@query(POLLS + " SELECT event_id, CASE WHEN age <= 36 THEN 24 ELSE 72 END AS target FROM aged WHERE (p24 = 0 AND age BETWEEN 18 AND 36) OR (p72 = 0 AND age BETWEEN 60 AND 84)")
def due_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = "(p24 = 0 and age between 18 and 36) or (p72 = 0 and age between 60 and 84)"
    return polled(spark, sf_dir).where(due).select("event_id", F.when(F.col("age") <= 36, 24).otherwise(72).alias("target"))


@query(POLLS + " SELECT event_id, CASE WHEN p72 = 0 AND age >= 84 THEN 72 ELSE 24 END AS target FROM aged WHERE (p24 = 0 AND age >= 36 AND age < 60) OR (p72 = 0 AND age >= 84) ORDER BY ts, event_id LIMIT 100")
def overdue_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred oldest tasks that are overdue: the limit is the feature."""
    over = polled(spark, sf_dir).where("(p24 = 0 and age >= 36 and age < 60) or (p72 = 0 and age >= 84)")
    return over.orderBy("ts", "event_id").limit(100).select("event_id", F.when((F.col("p72") == 0) & (F.col("age") >= 84), 72).otherwise(24).alias("target"))


@query(S.sql("conv", """SELECT c.genre, c.week, count(h.week) AS weeks, """ + s6("median(h.conv)") + " AS mid, " + s6("min(h.conv)") + " AS least, " + s6("max(h.conv)") + """ AS most
    FROM conv c LEFT JOIN conv h ON h.genre = c.genre AND h.week < c.week AND h.week >= c.week - 84 GROUP BY c.genre, c.week"""))
def range_history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each week's statistics over the twelve calendar weeks before it: every week is sent to the twelve after it."""
    conv = S.conversation(spark, sf_dir)
    past = R.later_weeks(conv.select("genre", "week", F.col("week").alias("past"), F.col("conv").alias("c")), "week", 12)
    own = conv.join(past, ["genre", "week"], "left")
    return own.groupBy("genre", "week").agg(F.count("past").alias("weeks"), r6(F.median("c")).alias("mid"), r6(F.min("c")).alias("least"), r6(F.max("c")).alias("most"))


@query(S.sql("conv", "SELECT week, genre, CAST(ntile(10) OVER (PARTITION BY week ORDER BY conv DESC, genre) AS INTEGER) AS decile FROM conv"))
def ntile_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.conversation(spark, sf_dir).select("week", "genre", F.ntile(10).over(Window.partitionBy("week").orderBy(F.col("conv").desc(), "genre")).alias("decile"))


MEMBERS = "SELECT o_custkey AS artist, s_nationkey AS genre, CAST(count(*) AS DOUBLE) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artist, genre, w): lines of a customer by the suppliers' nation."""
    lines = S.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    suppliers = S.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("genre"))
    orders = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("artist"))
    return lines.join(suppliers, "l_suppkey").join(orders, "l_orderkey").groupBy("artist", "genre").agg(F.count(F.lit(1)).cast("double").alias("w"))


@query(f"WITH m AS ({MEMBERS}) SELECT artist, genre, {s6('w / sum(w) OVER (PARTITION BY artist)')} AS w FROM m")
def weights_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.weights_to_one(memberships(spark, sf_dir), "w", ["artist"]).select("artist", "genre", r6("w").alias("w"))


@query("""WITH t AS (SELECT p_partkey, list_distinct([lower(trim(p_type)), lower(trim(p_brand)), nullif(lower(trim(p_type)), 'x')]) AS tags FROM part)
    SELECT p_partkey, unnest(tags) AS tag FROM t""")
def unnest_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda c: F.lower(F.trim(F.col(c)))
    tags = F.array_compact(F.array_distinct(F.array(tag("p_type"), tag("p_brand"), F.nullif(tag("p_type"), F.lit("x")))))
    return S.read(spark, sf_dir, "part").select("p_partkey", F.explode(tags).alias("tag"))


@query("""SELECT DISTINCT l_partkey, s_suppkey AS credit_id, lower(s_name) AS credit_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def unnest_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits collected as structs by part and taken apart again."""
    suppliers = S.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    credits = S.read(spark, sf_dir, "lineitem").join(suppliers, "l_suppkey").groupBy("l_partkey").agg(F.collect_set(F.struct(F.col("l_suppkey").alias("id"), F.col("s_name").alias("name"))).alias("credits"))
    return credits.select("l_partkey", F.explode("credits").alias("c")).select("l_partkey", F.col("c.id").alias("credit_id"), F.lower("c.name").alias("credit_name"))


@query("SELECT lower(p_brand) AS tag FROM part UNION SELECT lower(p_type) FROM part UNION SELECT lower(c_mktsegment) FROM customer")
def union_distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, customer = S.read(spark, sf_dir, "part"), S.read(spark, sf_dir, "customer")
    return part.select(F.lower("p_brand").alias("tag")).union(part.select(F.lower("p_type"))).union(customer.select(F.lower("c_mktsegment"))).distinct()


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.read(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query("SELECT p_partkey FROM part LEFT JOIN (SELECT l_partkey, max(l_discount) AS d FROM lineitem GROUP BY 1) ON p_partkey = l_partkey WHERE l_partkey IS NULL OR d < 0.09")
def anti_left_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a supporting row, or with one whose claim is missing: not a pure anti join."""
    best = S.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_discount").alias("d"), F.lit(1).alias("has"))
    return S.read(spark, sf_dir, "part").select("p_partkey").join(best, "p_partkey", "left").where("has is null or d < 0.09").select("p_partkey")


@query(S.sql("conv", "SELECT genre, week, posts FROM conv WHERE week IN (SELECT week FROM conv GROUP BY week ORDER BY week DESC LIMIT 8)"))
def semi_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recent(S.conversation(spark, sf_dir), "week", 8).select("genre", "week", "posts")


@query("""WITH v AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 'v1' ELSE 'v2' END AS version FROM orders)
    SELECT 'active' AS view, o_orderkey, o_totalprice FROM v WHERE version = 'v2' UNION ALL SELECT 'legacy', o_orderkey, o_totalprice + 1 FROM orders""")
def active_or_legacy_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with an active version, and with none."""
    orders = S.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    versioned = orders.withColumn("version", F.when(F.col("o_orderkey") % 2 == 0, "v1").otherwise("v2"))
    legacy = orders.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    versions = spark.createDataFrame([("v1", False), ("v2", True)], "version string, active boolean")
    view = lambda name, known: R.active_or_legacy(versioned, known, legacy).select(F.lit(name).alias("view"), "o_orderkey", "o_totalprice")
    return view("active", versions).unionByName(view("legacy", versions.withColumn("active", F.lit(False))))


@query("""WITH old AS (SELECT o_orderkey, o_totalprice AS claim FROM orders), new AS (SELECT l_orderkey, sum(l_extendedprice) AS claim FROM lineitem WHERE l_discount > 0.05 GROUP BY 1)
    SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN 'absent' ELSE 'unsupported' END AS reason FROM old LEFT JOIN new ON l_orderkey = o_orderkey WHERE new.claim IS NULL OR new.claim < 1000""")
def withdrawals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old claims that the new computation no longer supports."""
    new = S.read(spark, sf_dir, "lineitem").where("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("claim"))
    own = S.read(spark, sf_dir, "orders").select("o_orderkey").join(new, "o_orderkey", "left").where("claim is null or claim < 1000")
    return own.select("o_orderkey", F.when(F.col("claim").isNull(), "absent").otherwise("unsupported").alias("reason"))


@query("""SELECT (SELECT count(*) FROM lineitem WHERE l_quantity <= 0 OR l_discount < 0 OR l_discount > 1) AS invalid,
    (SELECT count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)) AS unsupported""")
def validate_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of violations, which must be 0 before a version is published."""
    lines = S.read(spark, sf_dir, "lineitem")
    orphans = lines.join(S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("unsupported"))
    return lines.agg(F.count_if(F.expr("l_quantity <= 0 or l_discount < 0 or l_discount > 1")).alias("invalid")).crossJoin(orphans)


@query("""WITH old AS (SELECT c_custkey AS k, c_name AS v, 'name' AS kind FROM customer WHERE c_custkey % 2 = 0),
    new AS (SELECT c_custkey AS k, upper(c_name) AS v, CASE WHEN c_custkey % 3 = 0 THEN 'mbid' ELSE 'name' END AS kind FROM customer WHERE c_custkey % 5 <> 0)
    SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL OR n.kind = 'mbid' THEN n.v ELSE o.v END AS v, CASE WHEN o.k IS NULL OR n.kind = 'mbid' THEN n.kind ELSE o.kind END AS kind
    FROM old o FULL JOIN new n ON o.k = n.k""")
def upsert_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.read(spark, sf_dir, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit("name").alias("kind"))
    new = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("v"), F.when(F.col("c_custkey") % 3 == 0, "mbid").otherwise("name").alias("kind"))
    return R.upsert(old, new, ["k"], F.col("kind") == "mbid")


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE upper(c_name) END AS v FROM customer""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.read(spark, sf_dir, "customer")
    return R.insert_absent(c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), c.select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("v")), ["k"])


@query(S.sql("grid", f"""SELECT week, genre, {s6('conv')} AS conv, {s6('listen')} AS listen, {s6('releases')} AS releases FROM grid WHERE conv IS NOT NULL"""))
def pivot_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid as long estimates and wide again."""
    long = R.unpivot(S.grid(spark, sf_dir), ["week", "genre"], ["conv", "listen", "releases"])
    return R.pivot(long, ["week", "genre"], "metric", "value", ["conv", "listen", "releases"]).select("week", "genre", *(r6(c).alias(c) for c in ("conv", "listen", "releases")))


@query(S.sql("grid", f"""SELECT week, genre, metric, {s6('value')} AS value FROM (SELECT week, genre, conv, listen, releases FROM grid) UNPIVOT INCLUDE NULLS (value FOR metric IN (conv, listen, releases))"""))
def unpivot_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unpivot(S.grid(spark, sf_dir), ["week", "genre"], ["conv", "listen", "releases"]).select("week", "genre", "metric", r6("value").alias("value"))


@query("SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 2")
def having_two_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = S.read(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    return own.groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n")).where("n = 2").select("o_custkey")


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_quantity DESC, l_partkey) AS parts, arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS first_supplier FROM lineitem GROUP BY l_orderkey")
def ordered_list_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct((-F.col("l_quantity")).alias("q"), "l_partkey")))
    return S.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(parts, lambda x: x["l_partkey"].cast("string")), ",").alias("parts"), F.min_by("l_suppkey", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("first_supplier"))


@query("SELECT count(*) AS rows, md5(string_agg(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}), '' ORDER BY n_nationkey)) AS digest FROM nation")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ordered_digest(S.read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


@query("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, count(*) AS n FROM events GROUP BY ALL")
def json_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH m AS (SELECT l_shipdate, 'ship' AS source, s_nationkey AS genre, l_partkey AS member FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'
      UNION ALL SELECT o_orderdate, 'order', c_nationkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'A'),
    p AS (SELECT genre, member, count(DISTINCT source) AS s FROM m GROUP BY 1, 2), n AS (SELECT genre, count(DISTINCT source) AS sources FROM m GROUP BY 1)
    SELECT genre, any_value(sources) AS sources, {s6('CASE WHEN any_value(sources) >= 2 THEN count(*) FILTER (WHERE s >= 2) / CAST(count(*) AS DOUBLE) END')} AS overlap FROM p JOIN n USING (genre) GROUP BY genre""")
def source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.read(spark, sf_dir, "lineitem")
    suppliers = S.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("genre"))
    orders = S.read(spark, sf_dir, "orders").join(S.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("genre"))
    ship = lines.where("l_returnflag = 'R'").join(suppliers, "l_suppkey").select(F.lit("ship").alias("source"), "genre", F.col("l_partkey").alias("member"))
    order = lines.where("l_returnflag = 'A'").join(orders, "l_orderkey").select(F.lit("order").alias("source"), "genre", F.col("l_partkey").alias("member"))
    return R.source_overlap(ship.unionByName(order), ["genre"], "source", "member").select("genre", "sources", r6("overlap").alias("overlap"))


@query(S.sql("conv", f"SELECT genre, week, {s6('conv')} AS conv FROM conv WHERE family = 2 ORDER BY conv DESC NULLS LAST, genre, week LIMIT 50 OFFSET 20"))
def optional_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = R.optional(S.conversation(spark, sf_dir), family=2, genre=None)
    return R.page(df, [F.col("conv").desc_nulls_last(), F.col("genre"), F.col("week")], 50, 20).select("genre", "week", r6("conv").alias("conv"))


@query(S.sql("conv", f"SELECT week, genre, {s6('conv')} AS conv FROM conv WHERE genre = 7 AND week IN (SELECT week FROM conv WHERE genre = 7 ORDER BY week DESC LIMIT 26)"))
def recent_n_resorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recent(S.conversation(spark, sf_dir).where("genre = 7"), "week", 26).select("week", "genre", r6("conv").alias("conv"))


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN 0 WHEN value > 50 THEN 1 ELSE 2 END AS tier FROM events
    ORDER BY tier, ts DESC, event_id LIMIT 100""")
def relevance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred by tier, then the newest."""
    tier = F.when(F.col("event_type") == "purchase", 0).when(F.col("value") > 50, 1).otherwise(2)
    return S.read(spark, sf_dir, "events").withColumn("tier", tier).orderBy("tier", F.col("ts").desc(), "event_id").limit(100).select("event_id", "tier")


@query("SELECT c_custkey, CAST(CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16)) AS UBIGINT) % 16 AS INTEGER) AS shard FROM customer")
def deterministic_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "customer").select("c_custkey", R.shard(F.col("c_custkey"), 16).alias("shard"))


@query("""SELECT c_custkey, c_mktsegment, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS t FROM customer)
    ORDER BY t, c_mktsegment, c_nationkey LIMIT 300""")
def stratified_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 300, drawn from the strata in turn."""
    return R.stratified(S.read(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 300).select("c_custkey", "c_mktsegment", "c_nationkey")


@query("SELECT p_retailprice AS s, min(p_brand) AS d FROM part WHERE p_brand IS NOT NULL GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def unique_key_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys seen with one value only are promoted to it, others are not: prices of one brand."""
    return R.unique_match(S.read(spark, sf_dir, "part"), "p_retailprice", "p_brand").select(F.col("p_retailprice").alias("s"), F.col("p_brand").alias("d"))


@query("SELECT c_name, min(c_nationkey) AS d FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1 HAVING count(DISTINCT c_nationkey) = 1 UNION ALL SELECT p_name, min(p_size) FROM part WHERE p_size IS NOT NULL GROUP BY 1 HAVING count(DISTINCT p_size) = 1")
def unique_name_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unique_key_promotion over whole tables: customers' names seen with one nation, and parts' with one size."""
    customers = R.unique_match(S.read(spark, sf_dir, "customer"), "c_name", "c_nationkey").select("c_name", F.col("c_nationkey").alias("d"))
    return customers.unionByName(R.unique_match(S.read(spark, sf_dir, "part"), "p_name", "p_size").select(F.col("p_name").alias("c_name"), F.col("p_size").alias("d")))
