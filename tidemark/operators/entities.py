"""The ladder from posts to entities: direct links, names matched to aliases, outcomes, and what to try again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.texts import host_in, name_grams, name_keys, name_typical, name_words, token_set_ratio
from tidemark.operators.relational import first_by
from tidemark.sources.tables import settled

#: Words, and pairs of characters, whose counts are known to all tasks, those that most aliases hold; the others count as
#: equally rare.
FREQUENT = 10_000


def linked_path(url: Column, hosts: Sequence[str], pattern: str, group: int = 1) -> Column:
    """A group of the pattern in the path of a URL whose host is one of hosts or below one; NULL elsewhere and for
    malformed URLs. %-escapes are decoded; where they are broken the result is NULL."""
    found = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), pattern, group)
    return F.when(host_in(url, hosts) & (found != ""), F.try_url_decode(found))


def _prepared(texts: DataFrame, column: str, *carried: str) -> DataFrame:
    """Distinct texts with what they carry, and their length as compared: that of their sorted distinct words."""
    own = texts.select(column, *carried).distinct().withColumn("n", F.length(F.array_join(name_words(column), " ")))
    return own.where("n > 0")


def _rarest_first(texts: DataFrame, column: str, keys: str, held: DataFrame) -> DataFrame:
    """texts with their keys in the order of held (key, n_held; others before them), one order for all texts."""
    long = texts.select(column, F.explode(keys).alias("key")).join(held, "key", "left")
    order = long.groupBy(column).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n_held", F.lit(0)).alias("n"), "key"))).alias("_o"))
    return texts.drop(keys).join(order, column).withColumn(keys, F.transform("_o", lambda x: x["key"])).drop("_o")


def _by_words(left: DataFrame, right: DataFrame, least: float, *, cuts: bool) -> DataFrame:
    """(name, columns of right): pairs with a typical word of one side among the words of the other, or with a cut in common;
    some more than once, and by chance others."""
    words = right.select(F.explode(name_words("alias")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    held = {r["word"]: r["n"] for r in words.where("n > 1").orderBy(F.col("n").desc(), "word").limit(FREQUENT).collect()}
    # a word that most names hold, and that is typical of no alias, would bring them all to one task for nothing
    asked = {r["word"] for r in right.select(F.explode(name_typical(F.col("alias"), held, least)).alias("word")).where(F.col("word").isin(list(held))).distinct().collect()} if held else set()
    # names are few bytes and much work: a given number of parts is not joined into fewer
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = lambda df, keys: df.drop("n").repartition(parts).select("*", F.explode(keys).alias("key"))
    mine, theirs = key(left, name_keys(F.col("name"), "<", ">", held, least, asked=asked, cuts=cuts)), key(right, name_keys(F.col("alias"), ">", "<", held, least, cuts=cuts))
    # keys are many times their names, and Spark takes them for as few: never through the driver
    return mine.hint("merge").join(theirs.hint("merge"), "key").drop("key")


def _by_grams(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(name, columns of right): pairs with rare pairs of characters in common, and enough of all; those lengths apart of which
    two texts may differ by more than a character each."""
    t = least / 100
    lengths = [{r["n"] for r in df.select("n").distinct().collect()} for df in (left, right)]
    shared = lambda a, b: -int(-((a + b) * (t / 2) - 1e-6) // 1)
    met = [(a, b) for a in lengths[0] for b in lengths[1] if (m := shared(a, b)) <= min(a, b) and max(a, b) - m > 1]
    kept = right.drop("n")
    if not met:
        return left.select("name").join(kept, F.lit(False))
    left, right = (df.select(c, "n", name_grams(c).alias("grams")) for df, c in ((left, "name"), (right, "alias")))
    held = F.broadcast(right.select(F.explode("grams").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_held")).orderBy(F.col("n_held").desc(), "key").limit(FREQUENT))
    left, right = _rarest_first(left, "name", "grams", held), _rarest_first(right, "alias", "grams", held)

    def prefixes(df: DataFrame, column: str, own: str, other: str) -> DataFrame:
        # m common characters of own + other have 2 m >= t (own + other); one that own lacks in other spoils two of its pairs,
        # one that is put in spoils one; where a character less on each side makes equal, the cuts find the pair
        pairs = df.sparkSession.createDataFrame(met, "a int, b int")
        df = df.join(F.broadcast(pairs.select(F.col(own).alias("n"), F.col(other).alias("o"))), "n")
        m = F.ceil((F.col("n") + F.col("o")) * (t / 2) - 1e-6)
        spoilt = (2 * F.col("n") + F.col("o") - 3 * m).cast("int")
        return df.select(column, F.col("n").alias(own), F.col("o").alias(other), F.explode(F.slice("grams", F.lit(1), spoilt + 1)).alias("key"))

    keyed = prefixes(left, "name", "a", "b").hint("merge").join(prefixes(right, "alias", "b", "a").hint("merge"), ["key", "a", "b"]).select("name", "alias", "a", "b").distinct()
    keyed = keyed.join(left.select("name", F.col("grams").alias("x")).hint("merge"), "name").join(right.select("alias", F.col("grams").alias("y")).hint("merge"), "alias")
    m = F.ceil((F.col("a") + F.col("b")) * (t / 2) - 1e-6)
    near = keyed.where(F.size(F.array_intersect("x", "y")) >= F.col("a") + 1 - (2 * F.col("a") + F.col("b") - 3 * m)).select("name", "alias")
    return near.join(kept.hint("merge"), "alias").select("name", *kept.columns)


def _candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(name, columns of right): all pairs that can score `least`, by prefix filters, some more than once; see scored_names."""
    return _by_words(left, right, least, cuts=True).unionByName(_by_grams(left, right, least))


def _scored(pairs: DataFrame) -> DataFrame:
    """pairs, each once, with their score. A filter on it would be worked out before they are dealt, and a second time: that
    belongs behind an aggregation."""
    # pairs are few bytes and much work: a given number of parts is not joined into fewer
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(parts, "name").dropDuplicates(["name", "alias"]).withColumn("score", token_set_ratio("name", "alias"))


def scored_names(names: DataFrame, aliases: DataFrame, *, least: float = 87.0) -> DataFrame:
    """(name, entity, score): each distinct name with all entities that score at least `least`, by the best of their
    aliases (entity, alias). Distinct names and aliases meet, however many posts hold them.

    No such pair is missed. A score comes from common words that make up most of one side, which then has one of its
    rarest words in the other (a word of all aliases is a key only for names of nothing else); or from two texts of
    similar length, which then are equal less a character each, or, where more may differ, have one of their rarest pairs of
    characters in common, and enough of all.
    """
    if least < 70:
        raise ValueError("pairs of characters find scores of 70 and more")
    left, _ = settled(_prepared(names.where("name is not null"), "name"), "names")
    right = aliases.select("entity", "alias").where("entity is not null and alias is not null").distinct()
    texts, _ = settled(_prepared(right, "alias"), "aliases")
    pairs = _scored(_candidates(left, texts, least))
    return pairs.join(right.hint("merge"), "alias").groupBy("name", "entity").agg(F.max("score").alias("score")).where(F.col("score") >= least)


def best_names(names: DataFrame, aliases: DataFrame, *, least: float = 87.0) -> DataFrame:
    """(name, entity, score): each distinct name with the entity that scores best, `least` at least; ties go to the least
    entity. The same as the first of scored_names, with fewer pairs: an alias stands for its least entity, and a name with a
    score of 100, which takes words alone, is compared no further."""
    if least < 70:
        raise ValueError("pairs of characters find scores of 70 and more")
    left, _ = settled(_prepared(names.where("name is not null"), "name"), "names")
    first = aliases.where("entity is not null and alias is not null").groupBy("alias").agg(F.min("entity").alias("entity"))
    right, _ = settled(_prepared(first, "alias", "entity"), "aliases")

    def best(pairs: DataFrame, least: float) -> DataFrame:
        own = _scored(pairs).groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "entity")).alias("_b"))
        return own.select("name", "_b.entity", (-F.col("_b.s")).alias("score")).where(F.col("score") >= least)

    whole, _ = settled(best(_by_words(left, right, least, cuts=False), 100.0), "whole")
    rest, _ = settled(left.join(whole.hint("merge"), "name", "left_anti"), "names")
    return whole.unionByName(best(_candidates(rest, right, least), least))


def matched_names(names: DataFrame, aliases: DataFrame, *, floor: float = 90.0, margin: float = 3.0) -> DataFrame:
    """(name, entity, score, outcome): resolved, ambiguous if the second entity is within the margin, or no_match.
    Scores below floor - margin cannot change an outcome and are NULL."""
    best = first_by(scored_names(names, aliases, least=floor - margin - 1e-6), ["name"], [F.col("score").desc(), F.col("entity")], 2)
    top = best.groupBy("name").agg(F.max("score").alias("score"), F.min("score").alias("_low"), F.count(F.lit(1)).alias("_n"), F.min_by("entity", F.struct(-F.col("score"), "entity")).alias("entity"))
    close = (F.col("_n") > 1) & (F.col("score") - F.col("_low") <= margin)
    outcome = F.when(F.coalesce(F.col("score") < floor, F.lit(True)), "no_match").when(close, "ambiguous").otherwise("resolved")
    own = names.select("name").where("name is not null").distinct().join(top, "name", "left").withColumn("outcome", outcome)
    return own.select("name", F.when(F.col("outcome") == "resolved", F.col("entity")).alias("entity"), "score", "outcome")


def resolved_posts(posts: DataFrame, names: DataFrame, aliases: DataFrame, *, floor: float = 90.0, margin: float = 3.0) -> DataFrame:
    """(post_id, entity, method, score, outcome) for posts (post_id, direct) and their names (post_id, name).

    A direct link settles a post. Else its names' best resolved match does; if none is resolved, the post is ambiguous
    if a name is, no_match if it has names, and no_candidate if it has none.
    """
    open_names = names.where("name is not null").join(posts.where("direct is null").select("post_id"), "post_id", "left_semi")
    found = open_names.join(matched_names(open_names, aliases, floor=floor, margin=margin), "name")
    order = F.when(F.col("outcome") == "resolved", 0).when(F.col("outcome") == "ambiguous", 1).otherwise(2)
    best = first_by(found.withColumn("_o", order), ["post_id"], [F.col("_o"), F.col("score").desc_nulls_last(), F.col("name")])
    own = posts.select("post_id", "direct").join(best.select("post_id", "entity", "score", "outcome"), "post_id", "left")
    direct = F.col("direct").isNotNull()
    return own.select(
        "post_id",
        F.coalesce("direct", "entity").alias("entity"),
        F.when(direct, "link").when(F.col("entity").isNotNull(), "name").alias("method"),
        F.when(~direct, F.col("score")).alias("score"),
        F.when(direct, "resolved").otherwise(F.coalesce("outcome", F.lit("no_candidate"))).alias("outcome"),
    )


def pending(posts: DataFrame, attempts: DataFrame, upstream: DataFrame) -> DataFrame:
    """Posts to try: never tried, or tried before the newest reading of upstream (one row: newest) without being
    resolved to an id. attempts: (post_id, tried_at, resolved, kind), one row for each post."""
    own = posts.join(attempts.select("post_id", "tried_at", "resolved", "kind", F.lit(True).alias("_tried")), "post_id", "left").crossJoin(F.broadcast(upstream.agg(F.max("newest").alias("_newest"))))
    again = (F.col("_newest") > F.col("tried_at")) & (~F.coalesce("resolved", F.lit(False)) | F.coalesce(F.col("kind") == "name", F.lit(False)))
    return own.where(F.col("_tried").isNull() | again).select(*posts.columns)


def activation(quality: DataFrame, *, labels: int = 20, precision: float = 0.9, recall: float = 0.75) -> DataFrame:
    """quality (tp, fp, fn, precision, recall) with active: enough labels, precise and complete enough; NULL is not."""
    enough = F.col("tp") + F.col("fp") + F.col("fn") >= labels
    return quality.withColumn("active", F.coalesce(enough & (F.col("precision") >= precision) & (F.col("recall") >= recall), F.lit(False)))
