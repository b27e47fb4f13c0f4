"""Versions and incremental work: fingerprints, replacement by key, activation, closed windows, cuts and common keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import settled


def fingerprinted(df: DataFrame, keys: Sequence[str], items: Sequence[str]) -> DataFrame:
    """(keys, fingerprint): an order-free digest of each key's distinct rows of items. Repeated rows count once; the digest
    is a sum of row digests, so that a key of any number of rows is combined where its rows lie."""
    text = F.to_json(F.struct(*items), {"ignoreNullFields": "false"})
    part = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(*keys, part.alias("_d")).distinct().groupBy(*keys).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum("_d").cast("string")).alias("fingerprint"))


def changed_keys(new: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change): what must be computed again between two frames of fingerprints: added, changed or removed."""
    old = stored.select(*keys, F.col("fingerprint").alias("_old"))
    both = new.select(*keys, F.col("fingerprint").alias("_new")).join(old, list(keys), "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def replace_keys(table: DataFrame, rows: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with all rows of the changed keys deleted and the new rows of these keys in their place."""
    which = changed.select(*keys).distinct()
    return table.join(which, list(keys), "left_anti").unionByName(rows.join(which, list(keys), "left_semi"))


def activated(versions: DataFrame, name: str, kind: str, at: Column) -> DataFrame:
    """The table of (kind, version, active, activated_at) with one active version of the kind: others of it are put out,
    the named one is put in or added. Other kinds stay as they are."""
    rest = versions.where(~((F.col("kind") == kind) & (F.col("version") == name)))
    rest = rest.withColumn("active", F.col("active") & (F.col("kind") != kind))
    spark = versions.sparkSession
    new = spark.range(1).select(F.lit(kind).alias("kind"), F.lit(name).alias("version"), F.lit(True).alias("active"), at.cast(versions.schema["activated_at"].dataType).alias("activated_at"))
    return rest.unionByName(new)


def closed_window(as_of: Column, days: int = 14) -> Column:
    """struct(from, to): the days up to the last Sunday whose week is over at as_of."""
    if days <= 0:
        raise ValueError("a positive number of days is expected")
    monday = F.trunc(as_of.cast("date"), "week")
    return F.struct(F.date_sub(monday, days).alias("from"), F.date_sub(monday, 1).alias("to"))


def cut_in_three(df: DataFrame, value: str, by: Sequence[str], tie: Sequence[str], out: str = "third") -> DataFrame:
    """Adds low, middle or high: values are compared with those at a third and two thirds of the group's sorted ones, so
    that equal values are in one part. NULL for NULL. The two bounds are found by rank, not by collecting the group."""
    own = df.where(F.col(value).isNotNull()).select(*by, value, *tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    own = own.withColumn("_n", n).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(value, *tie)) - 1)
    at = lambda k: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * k / 3), F.col(value)))
    bounds = own.groupBy(*by).agg(at(1).alias("_a"), at(2).alias("_b"))
    return df.join(bounds, list(by), "left").withColumn(out, F.when(F.col(value) < F.col("_a"), "low").when(F.col(value) < F.col("_b"), "middle").when(F.col(value).isNotNull(), "high")).drop("_a", "_b")


def common_keys(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys that every frame has, once each. Frames of known small size should come first."""
    return reduce(lambda a, b: a.join(b, list(keys), "left_semi"), [df.select(*keys) for df in frames]).distinct()


def range_tree(df: DataFrame, ranges: Column, columns: Sequence[str], *, fanout: int = 16, levels: int | None = None) -> DataFrame:
    """(level, node, rows, digest): a hash tree over ordered ranges of a table.

    ranges numbers each row's range from 0 on, in the order that the table has (a key divided by a width). A leaf's digest
    is that of its number, its count of rows and the sums of the rows' digests: ranges are summed where their rows lie, and
    a range or row that a third of the table holds is no task of its own. A node of the next level has `fanout` children
    in order; with `levels` left open the tree ends in one root. Partitioning and order of rows change nothing; NULLs count.
    """
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    # sums of a lane's two halves as longs hold for 2**47 rows of a range, and cost less than sums of decimals
    lane = lambda i: F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("long").alias(f"_l{i}")
    rows = df.select(ranges.cast("long").alias("node"), F.md5(text.cast("binary")).alias("_d")).select("node", *map(lane, range(4)))
    high, low = (lambda i: F.sum(F.shiftright(f"_l{i}", 16)).cast("decimal(20,0)")), (lambda i: F.sum(F.col(f"_l{i}").bitwiseAND(0xFFFF)))
    leaves = rows.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", *((high(i) * 65536 + low(i)).cast("string") for i in range(4))).alias("_s"))
    now = leaves.select(F.lit(0).alias("level"), "node", "rows", F.sha2(F.concat_ws("/", F.col("node").cast("string"), F.col("rows").cast("string"), "_s"), 256).alias("digest"))
    if levels is None:
        last = df.agg(F.max(ranges.cast("long"))).first()[0] or 0
        levels = 0
        while last:
            last, levels = last // fanout, levels + 1
    out = now
    for level in range(1, levels + 1):
        # `fanout` children at most
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat_ws("=", x["node"].cast("string"), x["digest"])), ",")
        now = now.groupBy(F.floor(F.col("node") / fanout).alias("node")).agg(F.sum("rows").alias("rows"), F.sha2(children, 256).alias("digest")).select(F.lit(level).alias("level"), "node", "rows", "digest")
        out = out.unionByName(now)
    return out


def differing_ranges(new: DataFrame, stored: DataFrame, *, fanout: int = 16) -> DataFrame:
    """(node, change): leaves of two trees that are not equal: added, removed or changed. Only children of nodes that differ
    are compared, level by level from the highest that both have. Trees are settled first: every level reads them, and a
    tree that is not yet computed would hash its table again for each."""
    new, stored = settled(new, "tree")[0], settled(stored, "tree")[0]
    tops = [t.agg(F.max("level")).first()[0] for t in (new, stored)]
    # trees of different heights are compared from the lower one's top on
    top = min((t for t in tops if t is not None), default=0)
    found = None
    for level in range(top, -1, -1):
        a, b = (t.where(F.col("level") == level).select("node", F.col("digest").alias(c)) for t, c in ((new, "_a"), (stored, "_b")))
        if found is not None:
            parents = found.select(F.col("node").alias("_p"))
            a, b = (t.join(parents, F.floor(F.col("node") / fanout) == F.col("_p"), "left_semi") for t in (a, b))
        found = a.join(b, "node", "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return found.select("node", F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("changed").alias("change"))
