"""Relational operators that Spark has no single call for, as compositions of DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order (Spark keeps n rows a key before the shuffle)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def either_key_join(left: DataFrame, right: DataFrame, *, left_id: str, left_name: str, right_id: str, right_name: str) -> DataFrame:
    """Inner join on id where the left row has one, else on the lower-cased, trimmed name: two hash joins, not an OR."""
    by_id = left.where(F.col(left_id).isNotNull()).join(right, F.col(left_id) == F.col(right_id))
    named = left.where(F.col(left_id).isNull())
    by_name = named.join(right, F.lower(F.trim(F.col(left_name))) == F.lower(F.trim(F.col(right_name))))
    return by_id.unionByName(by_name)


def hours_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3600e6


def insert_absent(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table and those rows of new whose keys it lacks."""
    return table.unionByName(new.join(table.select(*keys), list(keys), "left_anti"))


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str], overwrites: Column | None = None) -> DataFrame:
    """New rows replace old ones of their keys; with a condition on the new row, only those that meet it do."""
    if overwrites is None:
        return table.join(new.select(*keys), list(keys), "left_anti").unionByName(new)
    strong = new.where(overwrites)
    kept = table.join(strong.select(*keys), list(keys), "left_anti")
    weak = new.where(~F.coalesce(overwrites, F.lit(False))).join(table.select(*keys), list(keys), "left_anti").join(strong.select(*keys), list(keys), "left_anti")
    return kept.unionByName(strong).unionByName(weak)


def active_or_legacy(versioned: DataFrame, versions: DataFrame, legacy: DataFrame) -> DataFrame:
    """Rows of the active version; the legacy rows if there is none."""
    active = versions.where("active").select("version")
    return versioned.join(active, "version", "left_semi").drop("version").unionByName(legacy.join(active.limit(1), F.lit(True), "left_anti"))


def pivot(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long to wide over a fixed list of names: one conditional aggregate each, in a single pass."""
    return df.where(F.col(name).isin(*names)).groupBy(*keys).agg(*(F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names))


def unpivot(df: DataFrame, keys: Sequence[str], names: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(names), name, value)


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Keeps rows equal to each argument that is given; None filters nothing."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit from 1 to 200 and a non-negative offset are expected")
    return df.orderBy(*order).offset(offset).limit(limit)


def recent(df: DataFrame, week: str, n: int) -> DataFrame:
    """The rows of the latest n weeks, oldest first."""
    weeks = df.select(week).distinct().orderBy(F.col(week).desc()).limit(n)
    return df.join(F.broadcast(weeks), week, "left_semi").orderBy(week)


def later_weeks(df: DataFrame, week: str, n: int) -> DataFrame:
    """Each row once for each of the n weeks after its own, which `week` then names: what has a range of weeks for a
    join condition becomes an equal join."""
    return df.withColumn(week, F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.date_add(week, i * 7))))


def unique_match(names: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys that were seen with exactly one value."""
    return names.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.countDistinct(value).alias("_n")).where("_n = 1").drop("_n")


def source_overlap(df: DataFrame, keys: Sequence[str], source: str, member: str) -> DataFrame:
    """Share of members found in at least two of a key's sources; NULL with fewer than two sources."""
    per = df.groupBy(*keys, member).agg(F.countDistinct(source).alias("_s"))
    sources = df.groupBy(*keys).agg(F.countDistinct(source).alias("sources"))
    shares = per.groupBy(*keys).agg((F.count_if(F.col("_s") >= 2) / F.count(F.lit(1))).alias("_o"))
    return shares.join(sources, list(keys)).select(*keys, "sources", F.when(F.col("sources") >= 2, F.col("_o")).alias("overlap"))


def fingerprint(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """(rows, digest): an order-free 128-bit sum over the rows' hashes, for tables of any size."""
    h = [F.xxhash64(F.lit(s), *(F.col(c) for c in sorted(df.columns))).cast("decimal(38,0)") for s in (1, 2)]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", F.sum(h[0]).cast("string"), F.sum(h[1]).cast("string")).alias("digest"))


def ordered_digest(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """(rows, digest): md5 over the rows' JSON in order, NULLs included. One row is built of all: for dimensions only;
    `fingerprint` takes tables of any size."""
    row = F.struct(*(F.col(c) for c in order), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("_j"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["_j"]), "").cast("binary")).alias("digest"))


def shard(key: Column, n: int) -> Column:
    """First eight bytes of a key's sha256 as a big-endian number, modulo n."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(n).cast("decimal(20,0)")).cast("int")


def stratified(df: DataFrame, strata: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """n rows taken from the strata in turn: every stratum's first, then every second, and so on."""
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    return df.withColumn("_t", turn).orderBy("_t", *strata).limit(n).drop("_t")


def weights_to_one(df: DataFrame, weight: str, keys: Sequence[str]) -> DataFrame:
    return df.withColumn(weight, F.col(weight) / F.nullif(F.sum(weight).over(Window.partitionBy(*keys)), F.lit(0.0)))
