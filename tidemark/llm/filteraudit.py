"""Filter interaction audit: what every filter of a chain removes, in every order in which the chain can be applied.

Documents are first counted by part and by the set of filters that they fail (a bit mask): at most 2**k cells a part for
k filters, however many documents there are. The cells' masks are unpivoted to one row per filter, which meets the steps
of all k! orders; a running bit-or over an order's earlier steps says what a cell has failed before. Conditional sums
give a step's counts, and a window over filter and part their totals over all orders. DataFrame functions throughout.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
#: Orders grow with the factorial of the filters: 720 for six.
MOST_FILTERS = 6
NAMES = "ABCDE"


def text_failures(text: Column) -> list[Column]:
    """Filters A to D of a text: under 200 words; under half of the words distinct; over 2 per cent A-Z; a character of #$%&*|."""
    words = F.array_remove(F.split(text, SPACE), "")
    total, distinct, upper, length = (x.cast("long") for x in (F.size(words), F.size(F.array_distinct(words)), F.regexp_count(text, F.lit("[A-Z]")), F.length(text)))
    return [total < 200, 100 * distinct < 50 * total, 100 * upper > 2 * length, text.rlike("[#$%&*|]")]


def mask_of(failures: Sequence[Column]) -> Column:
    """Bit i is set where failures[i] is true."""
    total = F.lit(0)
    for i, failed in enumerate(failures):
        total = total + F.when(failed, 1 << i).otherwise(0)
    return total.cast("int")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, documents, good, toxic): documents by source and by the filters of NAMES that they fail.

    Filter E is failed by documents whose text a smaller doc_id has too, anywhere in the table; texts are known by 128 bits
    of hash. Copies are counted by text, doc_id and part before they meet, so that a text that a third of all rows hold
    becomes a row for each part. A null text is empty and a null source the part ''. Rows of one doc_id count each, and do
    not make each other fail E; rows without doc_id never fail E, make none fail it, and have no labels. A doc_id with
    several labels is good or toxic if any of them says so.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
        mask_of(text_failures(text)).alias("mask"),
    )
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = own.groupBy("h1", "h2", "mask", "part", "doc_id").agg(F.count(F.lit(1)).alias("n")).join(known, "doc_id", "left")
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    # a text's rows of one part and one pair of labels: all, those without doc_id, and those of the smallest doc_id
    groups = counted.groupBy("h1", "h2", "mask", "part", *flags).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("h1", "h2"))
    groups = groups.withColumn("fine", F.col("unnamed") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    parted = F.explode(F.array(F.struct(F.lit(0).alias("bit"), F.col("fine").alias("n")), F.struct(F.lit(1 << 4).alias("bit"), (F.col("n") - F.col("fine")).alias("n"))))
    rows = groups.select("part", "mask", "good", "toxic", parted.alias("e")).where("e.n > 0")
    n = F.col("e.n")
    return rows.groupBy("part", F.col("mask").bitwiseOR(F.col("e.bit")).alias("mask")).agg(F.sum(n).alias("documents"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def interactions(counted: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for cells of
    (part, mask, documents, good, toxic) and filters named by one letter each; a row for every part, order and step.

    kept: documents that have failed nothing up to the step; removed: those that fail its filter first; redundant: those
    that fail it after another; unique_fails: those that fail it alone; shapley: the filter's removed over all orders.
    """
    if len(set(names)) != len(names) or not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"one to {MOST_FILTERS} different letters name the filters")
    spark = counted.sparkSession
    long = counted.select("*", F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.col("mask").bitwiseAND(F.lit(1 << i)).alias("bit")) for i, f in enumerate(names)])).alias("f")).select("part", "mask", "documents", "good", "toxic", "f.*")
    steps = spark.createDataFrame([("".join(order), step, f) for order in permutations(names) for step, f in enumerate(order, 1)], "filter_order string, step int, filter string")
    # k! x k rows, 600 for five filters, whatever the input
    placed = long.join(F.broadcast(steps), "filter")
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.bit_or("bit").over(before), F.lit(0)))
    fails, fresh, n = F.col("bit") != 0, F.col("before") == 0, F.col("documents")

    def total(which: Column, of: Column = n) -> Column:
        return F.sum(F.when(which, of).otherwise(0))

    out = placed.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & fresh).alias("kept"),
        total(fails & fresh).alias("removed"),
        total(fails & ~fresh).alias("redundant"),
        total(fails & (F.col("mask") == F.col("bit"))).alias("unique_fails"),
        total(fails & fresh, F.col("good")).alias("good_lost"),
        total(fails & fresh, F.col("toxic")).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of NAMES over docs, by source: 600 rows a source, none for an empty table. Other columns of docs, whatever
    their names, take no part. Nulls, repeated rows and labels are taken as in `cells`."""
    return interactions(cells(docs, labels), NAMES)
