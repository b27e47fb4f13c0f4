"""Evidence rows behind the metrics: which post, counter pair or release supports which category in which week."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.relational import first_by, weights_to_one


def conversation(posts: DataFrame, links: DataFrame, memberships: DataFrame, polls: DataFrame, *, target: int = 72, settled: int = 60) -> DataFrame:
    """(week, genre, post_id, weight, likes, mature): each post once a category, by its preferred link's best membership.

    links (post_id, artist, kind, score): those by id first, then the higher score. polls (post_id, hours, likes): the
    reading taken for the target, else the latest from `settled` hours on; without one the post is not mature.
    """
    link = first_by(links, ["post_id"], [(F.col("kind") == "mbid").desc(), F.col("score").desc(), F.col("artist")])
    own = posts.join(link.select("post_id", "artist"), "post_id").join(memberships, "artist")
    best = first_by(own, ["post_id", "genre"], [F.col("confidence").desc(), F.col("weight").desc(), F.col("artist")])
    late = polls.where((F.col("target") == target) | (F.col("target").isNull() & (F.col("hours") >= settled)))
    reading = first_by(late, ["post_id"], [F.col("hours").desc(), F.col("likes").desc()]).select("post_id", "likes")
    out = best.join(reading, "post_id", "left")
    return out.select("week", "genre", "post_id", "weight", "likes", F.col("likes").isNotNull().alias("mature"))


def supply(credits: DataFrame, memberships: DataFrame) -> DataFrame:
    """(release, genre, weight): the largest weight of a release's credited artists, adding up to 1 for each release."""
    own = credits.join(memberships, "artist").groupBy("release", "genre").agg(F.max("weight").alias("weight"))
    return weights_to_one(own, "weight", ["release"])


def receipts(evidence: DataFrame, unit: str) -> DataFrame:
    """(week, genre, unit): the ids that a cell rests on, one a row, however many there are."""
    return evidence.select("week", "genre", unit).distinct()


def receipt_lists(receipts: DataFrame, unit: str, most: int = 200) -> DataFrame:
    """(week, genre, units, total): the first ids of each cell in order, for a page of the read surface, and their number."""
    w = Window.partitionBy("week", "genre")
    own = receipts.withColumn("_r", F.row_number().over(w.orderBy(unit)))
    return own.groupBy("week", "genre").agg(F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.col(unit)))).alias("units"), F.count(F.lit(1)).alias("total"))


def refreshed(receipts: DataFrame, source: DataFrame, unit: str) -> DataFrame:
    """Receipts joined to what the source now says of each unit."""
    return receipts.join(source, unit)


def manifest(runs: DataFrame, started: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The runs' table with newly started runs reset, and counts of the rows that fell into each run's time.

    Runs and rows meet by day: a run is sent to each of its days, so that the join is an equal one.
    """
    kept = runs.join(started.select("run_id"), "run_id", "left_anti").unionByName(started)
    days = kept.select("run_id", "started_at", "finished_at", F.explode(F.sequence(F.to_date("started_at"), F.to_date("finished_at"))).alias("day"))
    for name, df in tables.items():
        per = df.groupBy("at").agg(F.count(F.lit(1)).alias("_n")).withColumn("day", F.to_date("at"))
        inside = per.join(days, "day").where((F.col("at") >= F.col("started_at")) & (F.col("at") < F.col("finished_at")))
        kept = kept.join(inside.groupBy("run_id").agg(F.sum("_n").alias(name)), "run_id", "left").na.fill(0, [name])
    return kept


def ecosystem(df: DataFrame, value: str, k: int, scope: str | None = None) -> DataFrame:
    """Concentration of a week's values in all categories, or within each family (scope is its column)."""
    from tidemark.functions.kernels import concentration

    return concentration(df, value, ["week", scope] if scope else ["week"], k, "genre")


CONCENTRATION = ("entropy", "hhi", "top_share")


def banded_ecosystem(grid: DataFrame, drawn: DataFrame, value: str, k: int, scope: str | None = None, confidence: float = 0.9) -> DataFrame:
    """(week, [scope], measure, value, lower, upper): ecosystem's measures with the quantiles of their draws (redrawn's grid,
    with the draw in k); the band holds the value."""
    from tidemark.functions.kernels import concentration

    by = ["week", scope] if scope else ["week"]
    lo, hi = (1 - confidence) / 2, (1 + confidence) / 2
    quantiles = concentration(drawn, value, [*by, "k"], k, "genre").groupBy(*by).agg(*(F.percentile(m, F.array(F.lit(lo), F.lit(hi))).alias(f"_{m}") for m in CONCENTRATION))
    both = concentration(grid, value, by, k, "genre").join(quantiles, by)
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value"), F.least(F.col(m), F.col(f"_{m}")[0]).alias("lower"), F.greatest(F.col(m), F.col(f"_{m}")[1]).alias("upper")) for m in CONCENTRATION))).alias("r")
    return both.select(*by, rows).select(*by, "r.*")


def change_of(df: DataFrame, by: list[str], week: str, value: str, weeks: int) -> DataFrame:
    """Adds value's change against the same key `weeks` calendar weeks before."""
    w = Window.partitionBy(*by).orderBy(F.datediff(F.col(week), F.lit("1970-01-05").cast("date")))
    return df.withColumn("change", F.col(value) - F.first(value).over(w.rangeBetween(-7 * weeks, -7 * weeks)))
