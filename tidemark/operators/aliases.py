"""Aliases of categories: who owns a name, exact resolution, and search inside names by pieces of characters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a piece; shorter queries are looked up by pieces of their own length.
PIECE = 3


def owned(aliases: DataFrame, fold: Callable[[Column], Column] = F.lower) -> DataFrame:
    """(folded, genre, family, owners, family_owners): each genre's folded aliases (genre, family, alias) once, with how many
    genres own the name in all and within the family. Empty and NULL names are none."""
    rows = aliases.select(F.trim(fold(F.col("alias"))).alias("folded"), "genre", "family").where("folded <> ''").distinct()
    every, within = Window.partitionBy("folded"), Window.partitionBy("folded", "family")
    return rows.withColumn("owners", F.count(F.lit(1)).over(every)).withColumn("family_owners", F.count(F.lit(1)).over(within))


def resolved(names: DataFrame, table: DataFrame, fold: Callable[[Column], Column] = F.lower) -> DataFrame:
    """(name, family, genre, method): names (name, family; NULL: any) to the one genre that owns them (`alias`), or else the
    one within the family that is asked for (`family`); else genre is NULL, `ambiguous` or `unknown`."""
    asked = names.select("name", "family").distinct().withColumn("folded", F.trim(fold(F.col("name"))))
    own = table.select("folded", "owners", F.col("genre").alias("_g"), F.col("family").alias("_f"), "family_owners")
    found = asked.join(own, "folded", "left").groupBy("name", "family").agg(
        F.max("owners").alias("_n"), F.min("_g").alias("_one"), F.min(F.when((F.col("_f") == F.col("family")) & (F.col("family_owners") == 1), F.col("_g"))).alias("_in")
    )
    method = F.when(F.col("_n").isNull(), "unknown").when(F.col("_n") == 1, "alias").when(F.col("_in").isNotNull(), "family").otherwise("ambiguous")
    return found.withColumn("method", method).select("name", "family", F.when(F.col("method") == "alias", F.col("_one")).when(F.col("method") == "family", F.col("_in")).alias("genre"), "method")


def _pieces(text: Column, length: Column | int) -> Column:
    n = length if isinstance(length, Column) else F.lit(length)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, n)))


def postings(table: DataFrame) -> DataFrame:
    """(piece, folded, held): every piece of 1 to PIECE characters of the distinct names, and how many names hold it."""
    names = table.select("folded").distinct()
    lengths = F.sequence(F.lit(1), F.least(F.length("folded"), F.lit(PIECE)))
    long = names.select("folded", F.explode(F.flatten(F.transform(lengths, lambda n: _pieces(F.col("folded"), n)))).alias("piece"))
    held = long.groupBy("piece").agg(F.count(F.lit(1)).alias("held"))
    return long.join(held, "piece").select("piece", "folded", "held")


def searched(queries: DataFrame, table: DataFrame, *, most: int = 20, fold: Callable[[Column], Column] = F.lower) -> DataFrame:
    """(query, place, genre, folded): for each query the first `most` names that contain it: equal ones, then those that begin
    with it, then others; shorter before longer, then by name and genre.

    Of a query's pieces only the one that fewest names hold is looked up; what it finds is compared whole. A query with a
    piece that no name holds finds nothing.
    """
    asked = queries.select("query").distinct().withColumn("q", F.trim(fold(F.col("query")))).where("q <> ''")
    index = postings(table)
    sizes = index.select("piece", "held").distinct()
    rarest = asked.select("query", "q", F.explode(_pieces(F.col("q"), F.least(F.length("q"), F.lit(PIECE)))).alias("piece")).join(sizes, "piece").groupBy("query", "q").agg(F.min_by("piece", F.struct("held", "piece")).alias("piece"))
    found = rarest.join(index.select("piece", "folded"), "piece").where(F.col("folded").contains(F.col("q"))).join(table.select("folded", "genre").distinct(), "folded")
    rank = F.when(F.col("folded") == F.col("q"), 0).when(F.col("folded").startswith(F.col("q")), 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("query").orderBy(rank, F.length("folded"), "folded", "genre"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("query", "place", "genre", "folded")
