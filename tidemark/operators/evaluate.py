"""Evaluation of predicted sets: micro-averaged precision and recall by any keys and their roll-ups, and what may go live."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The label of an item that belongs to nothing: it is no member of a set.
UNCLASSIFIED = "unclassified"


def counted_sets(items: DataFrame, predicted: DataFrame, actual: DataFrame, item: str, label: str, *, exact: Sequence[str] = ()) -> DataFrame:
    """items with tp, fp, fn and right: how an item's predicted set and its actual one, frames of (item, label), agree.

    UNCLASSIFIED and NULL are no members: an item predicted and labelled as nothing is right with nothing to count.
    Repeated members count once. exact names two columns of items, a predicted and an actual id: where the actual one is
    there and the predicted is another or missing, nothing of the set is right.
    """
    members = lambda df, flag: df.select(item, label).where(F.col(label).isNotNull() & (F.col(label) != UNCLASSIFIED)).distinct().withColumn(flag, F.lit(1))
    both = members(predicted, "_p").join(members(actual, "_a"), [item, label], "full")
    sums = both.groupBy(item).agg(F.count_if(F.col("_p").isNotNull() & F.col("_a").isNotNull()).alias("tp"), F.count_if(F.col("_a").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    out = items.join(sums, item, "left").na.fill(0, ["tp", "fp", "fn"])
    if exact:
        wrong = F.col(exact[1]).isNotNull() & ~F.col(exact[0]).eqNullSafe(F.col(exact[1]))
        out = out.withColumn("_w", wrong).withColumns({"fp": F.when(F.col("_w"), F.col("fp") + F.col("tp")).otherwise(F.col("fp")), "fn": F.when(F.col("_w"), F.col("fn") + F.col("tp")).otherwise(F.col("fn")), "tp": F.when(F.col("_w"), 0).otherwise(F.col("tp"))})
    right = (F.col("fp") + F.col("fn") == 0) & (~F.col("_w") if exact else F.lit(True))
    return out.withColumn("right", right).drop("_w")


def rolled_up(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(depth, keys, items, exact, tp, fp, fn, precision, recall) of counted_sets' rows by all keys, by all but the last, and
    so on to the whole (keys NULL). depth is the number of keys that are not rolled up, so that a key that is NULL itself
    is told apart. Precision and recall are NULL where nothing was predicted or labelled."""
    rolled = F.lit(len(keys))
    for k in keys:
        rolled = rolled - F.grouping(k)
    out = counts.rollup(*keys).agg(rolled.cast("int").alias("depth"), F.count(F.lit(1)).alias("items"), F.count_if("right").alias("exact"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    share = lambda other: F.try_divide(F.col("tp"), F.col("tp") + F.col(other))
    return out.select("depth", *keys, "items", "exact", "tp", "fp", "fn", share("fp").alias("precision"), share("fn").alias("recall"))
