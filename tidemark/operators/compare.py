"""Comparison of two published versions: ledgers of values, ranks, missing cells and forecasts, and release gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger(one: DataFrame, two: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, one, two, change): each key of either version once.

    change: added or removed (the key is in one version only), filled or withheld (its value is NULL in one version
    only), same (also if both are NULL) or changed.
    """
    a = one.select(*keys, F.col(value).alias("one"), F.lit(True).alias("_a"))
    b = two.select(*keys, F.col(value).alias("two"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("one").eqNullSafe(F.col("two")), "same")
    change = change.when(F.col("one").isNull(), "filled").when(F.col("two").isNull(), "withheld").otherwise("changed")
    return a.join(b, list(keys), "full").select(*keys, "one", "two", change.alias("change"))


def ranks(df: DataFrame, by: Sequence[str], key: str, value: str) -> DataFrame:
    """(by, key, rank): from the largest value down, ties to the smaller key; NULLs have no rank."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(key))
    return df.where(F.col(value).isNotNull()).select(*by, key, F.row_number().over(w).alias("rank"))


def rank_ledger(one: DataFrame, two: DataFrame, by: Sequence[str], key: str, value: str, top: int = 10) -> DataFrame:
    """(by, key, one, two, moved, top): ranks in both versions, places gained, and whether a key enters, stays in or
    leaves the first `top`."""
    both = ledger(ranks(one, by, key, value), ranks(two, by, key, value), [*by, key], "rank")
    was, now = (F.coalesce(F.col(c) <= top, F.lit(False)) for c in ("one", "two"))
    place = F.when(was & now, "stays").when(now, "enters").when(was, "leaves")
    return both.select(*by, key, "one", "two", (F.col("one") - F.col("two")).alias("moved"), place.alias("top"))


def missing_ledger(cells: DataFrame, one: DataFrame, two: DataFrame, keys: Sequence[str], value: str, by: Sequence[str]) -> DataFrame:
    """(by, both, only_one, only_two, neither): cells (keys) by the versions in which they have a value."""
    have = lambda df, name: df.where(F.col(value).isNotNull()).select(*keys, F.lit(True).alias(name))
    own = cells.join(have(one, "_a"), list(keys), "left").join(have(two, "_b"), list(keys), "left")
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return own.groupBy(*by).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_one"), F.count_if(~a & b).alias("only_two"), F.count_if(~a & ~b).alias("neither"))


def forecast_ledger(one: DataFrame, two: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, error_one, error_two, better): absolute errors of forecasts (predicted, actual) of the same targets."""
    error = F.abs(F.col("actual") - F.col("predicted"))
    both = ledger(one.withColumn("_e", error), two.withColumn("_e", error), keys, "_e")
    a, b = F.col("one"), F.col("two")
    better = F.when(a.isNull() | b.isNull(), "unpaired").when(a < b, "one").when(b < a, "two").otherwise("tie")
    return both.select(*keys, a.alias("error_one"), b.alias("error_two"), better.alias("better"))


def gates(df: DataFrame, expected: DataFrame, by: str, tests: dict[str, Column]) -> DataFrame:
    """(by, the tests, passed) for each expected group. Tests are boolean aggregates over a group's rows; one that is
    NULL has failed, and so have all those of a group without rows."""
    found = df.groupBy(by).agg(*(t.alias(n) for n, t in tests.items()))
    closed = [F.coalesce(F.col(n), F.lit(False)).alias(n) for n in tests]
    out = expected.select(by).distinct().join(found, by, "left").select(by, *closed)
    return out.withColumn("passed", F.array_min(F.array(*tests)))


def release(gated: DataFrame, everywhere: dict[str, Column]) -> DataFrame:
    """One row: whether all groups passed, the tests over all groups, and their conjunction; false without groups."""
    tests = {"groups_pass": F.bool_and("passed"), **everywhere}
    one = gated.agg(*(F.coalesce(t, F.lit(False)).alias(n) for n, t in tests.items()))
    return one.withColumn("released", F.array_min(F.array(*tests)))
