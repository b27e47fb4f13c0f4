"""Coverage of categories by week: what each source saw, how the sources meet, and whether a cell is fit for claims.

An artist or post that belongs to many categories stays one row with the array of its categories until all that counts
once is merged; only then are the categories unfolded, and counted in the same task, so that what is sent grows with the
evidence and not with its product with the categories. kinds is a set of bits. What was not seen is NULL, not 0.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.relational import first_by, unique_match
from tidemark.sources.tables import settled

Fold = Callable[[Column], Column]
CELL = ["genre", "week"]
COUNTS = ("tags", "artists", "valid_artists", "releases", "posts", "attempts")
ARTIST, RELEASE, POST = 1, 2, 4


@dataclass(frozen=True)
class Thresholds:
    """What a cell must show to be ready; the defaults are those of a weekly collection."""

    lookback_weeks: int = 52
    require_tag: bool = True
    artists: int = 25
    valid_artists: int = 10
    history: int = 2
    releases: int = 1
    posts: int = 5
    attempts: int = 5
    resolution_rate: float = 0.85
    overlap_artists: int = 2
    overlap_rate: float = 0.1
    max_age_days: int = 14


def plain(text: Column) -> Column:
    return F.lower(F.trim(text))


def alias_index(labels: DataFrame, fold: Fold = plain) -> DataFrame:
    """(alias, genre) of the labels (label, genre) that one category alone has."""
    own = labels.select(fold(F.col("label")).alias("alias"), "genre").where("alias is not null and alias <> ''")
    return unique_match(own, "alias", "genre")


def known_ids(names: Sequence[DataFrame], fold: Fold = plain) -> DataFrame:
    """(name, id) of the names that were seen with one id only, over frames with (name, id)."""
    out = None
    for df in names:
        own = df.select(fold(F.col("name")).alias("name"), F.lower("id").alias("id")).where("name <> '' and id <> ''")
        out = own if out is None else out.unionByName(own)
    return unique_match(out, "name", "id")


def keyed(df: DataFrame, ids: DataFrame, fold: Fold = plain) -> DataFrame:
    """Adds artist (its id, the id its name is known by, else its name) and name_key to rows with (name, id)."""
    known = ids.select(F.col("name").alias("_name"), F.col("id").alias("_known"))
    own = df.withColumn("_name", fold(F.col("name"))).join(known, "_name", "left")
    key = F.coalesce(F.nullif(F.lower("id"), F.lit("")), "_known")
    return own.withColumn("name_key", F.concat(F.lit("name:"), F.coalesce("_name", F.lit("")))).withColumn("artist", F.coalesce(F.concat(F.lit("id:"), key), "name_key")).drop("_name", "_known")


def _week(at: str) -> Column:
    return F.trunc(F.col(at).cast("date"), "week")


def _mapped(df: DataFrame, labels: str, index: DataFrame, fold: Fold) -> DataFrame:
    """Rows once for each label that names a category; the index is a dimension."""
    return df.withColumn("alias", F.explode(F.array_distinct(F.transform(labels, lambda x: fold(x))))).join(F.broadcast(index), "alias").drop("alias", labels)


def _united(arrays: str) -> Column:
    """Aggregate: the distinct members of a group's arrays."""
    return F.array_distinct(F.flatten(F.collect_set(arrays)))


def evidence(labels: DataFrame, tags: DataFrame, artists: DataFrame, releases: DataFrame, posts: DataFrame, links: DataFrame, ambiguities: DataFrame, fold: Fold = plain) -> tuple[DataFrame, DataFrame]:
    """(cells, weeks): COUNTS, latest, overlap_artists and overlap_rate by genre and week, and all weeks in which any source
    saw something, with a category or without.

    tags (tag, at); artists (name, id, labels, listeners, plays, at), of which the last of an artist's week counts;
    releases (release, released, labels, name, id, at), one row a credit, without a full date left out; posts (post,
    created_at, at); links (post, name, id, kind, score, at), of which one is preferred; ambiguities (post, name, id, at).
    An artist belongs to the categories of its observations and releases; a linked artist that has none is looked up by
    name.
    """
    index = alias_index(labels, fold)
    # who is cited, each name and id once
    who, _ = settled(links.select("name", "id").unionByName(ambiguities.select("name", "id")).distinct(), "who")
    ids, _ = settled(known_ids([artists.select("name", "id").distinct(), releases.select("name", "id").distinct(), who], fold), "ids")
    at = F.col("at").cast("timestamp")
    latest = F.max("at").alias("latest")

    told = tags.select(_week("at").alias("week"), fold(F.col("tag")).alias("alias"), at.alias("at"))
    tagged = told.groupBy("alias", "week").agg(F.max("at").alias("at")).join(F.broadcast(index), "alias").groupBy(*CELL).agg(F.count("alias").alias("tags"), latest)

    # dealt by artist once: an artist's weeks and all that follows stay there
    seen = keyed(artists.select("name", "id", "labels", "listeners", "plays", "at", _week("at").alias("week")), ids, fold).repartition("artist")
    last = first_by(seen, ["artist", "week"], [F.col("at").desc(), F.col("plays").desc(), F.col("listeners").desc(), F.col("name")])
    order = Window.partitionBy("artist").orderBy("week")
    grown = (F.datediff("week", F.lag("week").over(order)) == 7) & (F.col("listeners") >= F.lag("listeners").over(order)) & (F.col("plays") >= F.lag("plays").over(order))
    heard = _mapped(last.select("artist", "name_key", "week", at.alias("at"), "labels", F.coalesce(grown, F.lit(False)).alias("grown")), "labels", index, fold)
    heard, _ = settled(heard.groupBy("artist", "name_key", "week", "at", "grown").agg(F.collect_set("genre").alias("genres")), "heard")
    listened = heard.select("week", "at", "grown", F.explode("genres").alias("genre")).groupBy(*CELL).agg(F.count(F.lit(1)).alias("artists"), F.count_if("grown").alias("valid_artists"), latest)

    full = releases.where("released is not null").withColumn("week", _week("released"))
    issued, _ = settled(keyed(_mapped(full.select("release", "name", "id", "labels", "week", at.alias("at")), "labels", index, fold), ids, fold).select("release", "artist", "name_key", "week", "at", "genre"), "issued")
    supplied = issued.groupBy(*CELL, "release").agg(F.max("at").alias("at")).groupBy(*CELL).agg(F.count("release").alias("releases"), latest)

    of = [heard.groupBy("artist", "name_key").agg(_united("genres").alias("genres")), issued.groupBy("artist", "name_key").agg(F.collect_set("genre").alias("genres"))]
    of = of[0].unionByName(of[1])
    member, _ = settled(of.select("genres", F.explode(F.array("artist", "name_key")).alias("key")).groupBy("key").agg(_united("genres").alias("genres")), "member")

    # the categories of its own key, else of its name
    by = lambda key, genres: member.select(F.col("key").alias(key), F.col("genres").alias(genres))
    who = keyed(who, ids, fold).join(by("artist", "_g"), "artist", "left").join(by("name_key", "_n"), "name_key", "left")
    who = who.select(F.col("name").alias("_name"), F.col("id").alias("_id"), "artist", F.coalesce("_g", "_n").alias("genres")).where("genres is not null")

    said = posts.select("post", _week("created_at").alias("week"), F.col("at").alias("_at")).repartition("post").groupBy("post", "week").agg(F.max("_at").alias("_at"))
    cited = links.select("post", "name", "id", "at", (F.lower("kind") == "mbid").alias("_strong"), "score", F.lit(True).alias("_link"))
    cited = cited.unionByName(ambiguities.select("post", "name", "id", "at", F.lit(None).cast("boolean").alias("_strong"), F.lit(None).cast(links.schema["score"].dataType).alias("score"), F.lit(False).alias("_link")))
    # of a post's links the best one counts; its ambiguities count, all of them, where it has no link
    own = Window.partitionBy("post").orderBy(F.col("_link").desc(), F.col("_strong").desc_nulls_last(), F.col("score").desc_nulls_last(), F.col("at").desc_nulls_last(), F.col("name"), F.col("id"))
    cited = cited.withColumn("_n", F.row_number().over(own)).withColumn("_any", F.first("_link").over(own)).where("_n = 1 or not _any")
    cited = cited.join(said, "post").select("post", "week", "name", "id", "_link", F.greatest("at", "_at").cast("timestamp").alias("at"))
    placed = cited.join(who, F.col("name").eqNullSafe(F.col("_name")) & F.col("id").eqNullSafe(F.col("_id"))).select("post", "week", "_link", "artist", "genres", "at")
    # the post of a link is in one row a week; one of ambiguities is in several
    placed, _ = settled(placed, "placed")
    linked = placed.where("_link")
    counted = linked.select("week", "at", F.explode("genres").alias("genre")).groupBy(*CELL).agg(F.count(F.lit(1)).alias("posts"), F.count(F.lit(1)).alias("attempts"), latest)
    tried = placed.where("not _link").repartition("post", "week").select("post", "week", "at", F.explode("genres").alias("genre")).groupBy(*CELL, "post").agg(F.max("at").alias("at"))
    tried = tried.groupBy(*CELL).agg(F.count(F.lit(1)).alias("attempts"), latest)

    as_kind = lambda df, kind: df.select("artist", "week", "genres", F.lit(kind).alias("kind"))
    met = as_kind(heard, ARTIST).unionByName(as_kind(issued.groupBy("artist", "week").agg(F.collect_set("genre").alias("genres")), RELEASE)).unionByName(as_kind(linked.select("artist", "week", "genres").distinct(), POST))
    # dealt by artist and week with their arrays: kinds are united where the rows lie
    met = met.repartition("artist", "week").select("artist", "week", F.explode("genres").alias("genre"), "kind").groupBy(*CELL, "artist").agg(F.bit_or("kind").alias("kinds"))
    met = met.groupBy(*CELL).agg(F.bit_or("kinds").alias("_kinds"), F.count_if(F.bit_count("kinds") >= 2).alias("_twice"), F.count(F.lit(1)).alias("_artists"))

    cells = tagged
    for df in (listened, supplied, counted, tried, met):
        cells = cells.unionByName(df, allowMissingColumns=True)
    several = F.bit_count(F.max("_kinds")) >= 2
    cells = cells.groupBy(*CELL).agg(*(F.nullif(F.sum(name), F.lit(0)).alias(name) for name in COUNTS), F.max("latest").alias("latest"), F.when(several, F.max("_twice")).alias("overlap_artists"), F.when(several, F.max("_twice") / F.nullif(F.max("_artists"), F.lit(0))).alias("overlap_rate"))

    weeks = told.select("week").distinct()
    for df in (artists.select(_week("at").alias("week")), full.select("week"), posts.select(_week("created_at").alias("week"))):
        weeks = weeks.unionByName(df.distinct())
    # both have a row a week, or a week and a category: whoever reads them twice does not count again
    return settled(cells, "cells")[0], settled(weeks.where("week is not null").distinct(), "weeks")[0]


def week_range(weeks: DataFrame, lookback: int, start=None, end=None) -> DataFrame:
    """Every Monday from the first week seen, or the lookback before the last, to the last; both ends can be given.
    One row a week: no rows without any week."""
    for given in (start, end):
        if given is not None and given.weekday():
            raise ValueError("a Monday is expected")
    if start is not None and end is not None and start > end:
        raise ValueError("the first week is after the last")
    lit = lambda x: F.lit(x).cast("date")
    ends = weeks.agg(F.min("week").alias("first"), F.coalesce(lit(end), F.max("week")).alias("last"))
    floor = F.date_sub("last", 7 * (lookback - 1))
    ends = ends.withColumn("start", F.coalesce(lit(start), F.greatest("first", floor))).where("start <= last")
    return ends.select(F.explode(F.expr("sequence(start, last, interval 7 days)")).alias("week"))


def measured(cells: DataFrame, weeks: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds to every category and week the counts of its evidence, history (weeks so far with a tag or an artist),
    resolution_rate, overlap_artists, overlap_rate and latest.

    Weeks and categories are dimensions: their product is the report.
    """
    grid = weeks.crossJoin(categories).withColumn("_own", F.lit(True))
    so_far = F.count(F.when(F.col("tags").isNotNull() | F.col("artists").isNotNull(), 1)).over(Window.partitionBy("genre").orderBy("week"))
    out = grid.join(cells, CELL, "full").withColumn("history", F.nullif(so_far, F.lit(0))).where("_own").drop("_own")
    return out.withColumn("resolution_rate", F.coalesce("posts", F.when(F.col("attempts").isNotNull(), 0)) / F.col("attempts"))


def laddered(df: DataFrame, t: Thresholds, as_of: Column, unfit: Column | None = None) -> DataFrame:
    """Adds stale and state: the first rung that a cell does not reach, else ready. `unfit` marks categories that never
    count (rejected and collecting ones)."""
    less = lambda name, least: F.coalesce(F.col(name) < F.lit(least), F.lit(True))
    stale = F.coalesce(F.unix_micros(as_of.cast("timestamp")) - F.unix_micros("latest") > F.lit(t.max_age_days * 86_400_000_000), F.lit(True))
    rungs = [
        ("unsupported", stale if unfit is None else stale | F.coalesce(unfit, F.lit(False))),
        ("collecting_history", F.col("valid_artists").isNull() & F.coalesce(F.col("history") < t.history, F.lit(False))),
        ("insufficient_listening", (F.lit(t.require_tag) & F.col("tags").isNull()) | less("artists", t.artists) | less("valid_artists", t.valid_artists)),
        ("insufficient_conversation", less("posts", t.posts)),
        ("insufficient_supply", less("releases", t.releases)),
        ("insufficient_resolution", less("attempts", t.attempts) | less("resolution_rate", t.resolution_rate) | less("overlap_artists", t.overlap_artists) | less("overlap_rate", t.overlap_rate)),
    ]
    state = F.lit("ready")
    for name, unmet in reversed(rungs):
        state = F.when(unmet, name).otherwise(state)
    return df.withColumn("stale", stale).withColumn("state", state)


def coverage(categories: DataFrame, labels: DataFrame, sources: Mapping[str, DataFrame], thresholds: Thresholds, as_of: Column, *, unfit: Column | None = None, start=None, end=None, fold: Fold = plain) -> DataFrame:
    """One row for each category (genre, ...) and week; labels of unfit categories should be left out of `labels`."""
    cells, weeks = evidence(labels, *(sources[n] for n in ("tags", "artists", "releases", "posts", "links", "ambiguities")), fold=fold)
    return laddered(measured(cells, week_range(weeks, thresholds.lookback_weeks, start, end), categories), thresholds, as_of, unfit)
