"""A deterministic synthetic table of weekly readings, and the checks that it must pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weekly(cells: DataFrame) -> DataFrame:
    """(week, genre, conv, listen, releases) for cells (week, genre): closed forms of the weeks since the first and of the
    category's number, all positive."""
    first = cells.agg(F.min("week").alias("_first"))
    i, g = F.col("i").cast("double"), F.col("genre").cast("double")
    own = cells.crossJoin(F.broadcast(first)).withColumn("i", F.floor(F.datediff("week", "_first") / 7))
    conv = 50 + 3 * g + 0.25 * i + 10 * F.sin(i / 4 + g)
    listen = 400 + 20 * g + 2 * i + 80 * F.cos(i / 6 + g / 2)
    releases = F.floor(6 + 5 * F.sin(i * (2 * math.pi / 52) + g) ** 2).cast("long")
    return own.select("week", "genre", conv.alias("conv"), listen.alias("listen"), releases.alias("releases"))


def faults(df: DataFrame, rows: int, values: list[str]) -> DataFrame:
    """One row of counts that must all be 0: missing or surplus rows, repeated cells, NULL or negative values, weeks
    that do not begin on a Monday."""
    bad: Column = F.lit(False)
    for v in values:
        bad = bad | F.coalesce(F.col(v) < 0, F.lit(True))
    return df.agg(
        F.abs(F.count(F.lit(1)) - rows).alias("wrong_rows"),
        (F.count(F.lit(1)) - F.count_distinct("week", "genre")).alias("repeated"),
        F.count_if(bad).alias("bad_values"),
        F.count_if(F.weekday("week") != 0).alias("not_mondays"),
    )
