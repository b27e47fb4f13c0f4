"""Connected components of a graph given as a DataFrame of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import remove, written


def components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of links (a long, b long): component is the smallest node that can be reached.

    Each round connects every node's larger neighbours to its smallest one, then its smaller neighbours and itself to
    the smallest. Minima are aggregated before they move and joined back, so that no node's neighbours are gathered in
    one place. Rounds are written to the checkpoint folder, each in place of the one before; links with a null end and loops are ignored.
    """
    edges, before = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges, place = written(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        remove(links.sparkSession, before)
        before = place
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
