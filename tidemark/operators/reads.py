"""The read surface: each route as a function of tables and parameters, with its checks and its pages."""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.relational import first_by, optional, page, pivot

ESTIMATES = ("conversation", "listening", "supply", "opportunity", "gap")


def monday(week: datetime.date, as_of: datetime.date) -> datetime.date:
    if week.weekday() or week > as_of:
        raise ValueError("a Monday that is not in the future is expected")
    return week


def band(point: str, lower: str, upper: str) -> Column:
    """Point and interval as a unit: NULL if one of them is."""
    known = F.col(point).isNotNull() & F.col(lower).isNotNull() & F.col(upper).isNotNull()
    return F.when(known, F.struct(F.col(point).alias("value"), F.col(lower).alias("lower"), F.col(upper).alias("upper")))


def cursor(state: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(state, sort_keys=True, default=str).encode()).decode()


def state(text: str) -> dict:
    return json.loads(base64.urlsafe_b64decode(text.encode()))


def has_more(rows: Sequence, limit: int) -> tuple[Sequence, bool]:
    """Of limit + 1 fetched rows those of the page, and whether others follow."""
    return rows[:limit], len(rows) > limit


def token(route: str, parameters: dict, after: Sequence) -> str:
    """Where a page ended, bound to its route and parameters."""
    return cursor({"route": route, "of": hashlib.sha256(cursor(parameters).encode()).hexdigest()[:16], "after": list(after)})


def resumed(text: str, route: str, parameters: dict, keys: int) -> list:
    """The last row's keys of a token; ValueError if it is none, or one of another route or other parameters."""
    try:
        found = state(text)
        after = found["after"]
        fits = (found["route"], found["of"]) == (route, state(token(route, parameters, ()))["of"]) and isinstance(after, list) and len(after) == keys
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("not a cursor") from e
    if not fits:
        raise ValueError("the cursor belongs to another request")
    return after


def page_after(df: DataFrame, order: Sequence[tuple[str, bool]], limit: int, after: Sequence | None = None) -> DataFrame:
    """limit + 1 rows behind a row's keys in an order of (column, descending) that tells all rows apart: the one more shows
    whether others follow. Ordering columns are not NULL. Rows that come or go before a page move no later page."""
    if not 1 <= limit <= 1000:
        raise ValueError("1 to 1000 rows are expected")
    if after is not None:
        behind, equal = F.lit(False), F.lit(True)
        for (c, descending), value in zip(order, after, strict=True):
            at = F.lit(value).cast(df.schema[c].dataType)
            behind = behind | (equal & (F.col(c) < at if descending else F.col(c) > at))
            equal = equal & (F.col(c) == at)
        df = df.where(behind)
    return df.orderBy(*(F.col(c).desc() if descending else F.col(c).asc() for c, descending in order)).limit(limit + 1)


def feed(posts: DataFrame, *, limit: int = 50, after: Sequence | None = None) -> DataFrame:
    """A page of the feed (week, post_id, likes): newest week first, then most liked, then post."""
    return page_after(posts, [("week", True), ("likes", True), ("post_id", False)], limit, after)


def ecosystem(rows: DataFrame, *, family: int | None = None, weeks: int = 52) -> DataFrame:
    """The latest weeks of a family, or of each."""
    if not 1 <= weeks <= 260:
        raise ValueError("1 to 260 weeks are expected")
    return first_by(optional(rows, family=family), ["family"], [F.col("week").desc()], weeks)


def taxonomy(categories: DataFrame, *, family: int | None = None) -> DataFrame:
    """Families with their categories (genre, name) in the order of names."""
    own = optional(categories, family=family)
    return own.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.transform(F.array_sort(F.collect_list(F.struct("name", "genre"))), lambda x: x["genre"]).alias("genres"))


def briefs(rows: DataFrame, evidence: DataFrame, *, week: datetime.date | None = None) -> DataFrame:
    """Candidates (genre, week) of a week, or of the latest, each with its evidence (genre, kind, id, score) in order."""
    own = at_week(rows, week)
    order = F.array_sort(F.collect_list(F.struct("kind", (-F.col("score")).alias("s"), "id")))
    return own.join(evidence.join(own.select("genre"), "genre", "left_semi").groupBy("genre").agg(F.transform(order, lambda x: F.concat_ws(":", x["kind"], x["id"].cast("string"))).alias("evidence")), "genre", "left")


def closed(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows of weeks that ended before as_of."""
    return df.where(F.col("week") < F.trunc(as_of, "week"))


def latest_week(df: DataFrame, as_of: Column, claim: str = "opportunity") -> DataFrame:
    return closed(df, as_of).where(F.col(claim).isNotNull()).agg(F.max("week").alias("week"))


def opportunities(rows: DataFrame, *, week: datetime.date, limit: int = 25, offset: int = 0, family: int | None = None, descending: bool = True) -> DataFrame:
    own = optional(rows.where(F.col("opportunity").isNotNull()), week=week, family=family)
    by = F.col("opportunity").desc_nulls_last() if descending else F.col("opportunity").asc_nulls_last()
    return page(own, [by, F.col("genre")], limit, offset)


def timeseries(rows: DataFrame, genre, weeks: int = 52) -> DataFrame:
    """A category's latest weeks, oldest first; the name is matched without regard to case."""
    if not 1 <= weeks <= 260:
        raise ValueError("1 to 260 weeks are expected")
    key = F.lower(F.col("name")) == genre.lower() if isinstance(genre, str) else F.col("genre") == genre
    return rows.where(key).orderBy(F.col("week").desc()).limit(weeks).orderBy("week")


def estimates_wide(long: DataFrame, context: str) -> DataFrame:
    return pivot(long.where(F.col("context") == context), ["week", "genre"], "metric", "value", ESTIMATES)


def evidence(receipts: DataFrame, *, genre, week: datetime.date, order: str, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(receipts.where((F.col("genre") == genre) & (F.col("week") == F.lit(week))), [F.col(order).desc_nulls_last(), F.col("post_id")], limit, offset)


def next_up(rows: DataFrame) -> DataFrame:
    """The rows of the latest origin, by rank."""
    return rows.join(F.broadcast(rows.agg(F.max("origin").alias("origin"))), "origin").orderBy("place")


def scene(coordinates: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each category's latest coordinates with its metrics of the latest week."""
    last = first_by(coordinates, ["genre"], [F.col("week").desc()]).drop("week")
    return last.join(metrics.join(F.broadcast(metrics.agg(F.max("week").alias("week"))), "week"), "genre")


def search(categories: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Categories whose name has the text, those that begin with it first."""
    name = F.lower("name")
    return page(categories.where(name.contains(text.lower())), [(~name.startswith(text.lower())).asc(), F.col("name")], limit)


def health(tables: dict[str, DataFrame], runs: DataFrame) -> DataFrame:
    """One row: a count of every table, and the latest run or NULLs."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out.join(runs.orderBy(F.col("started_at").desc()).limit(1), F.lit(True), "left")


def at_week(rows: DataFrame, week: datetime.date | None = None, name: str = "week") -> DataFrame:
    """The rows of a week, or of the latest one there is; the latest is one row, joined back."""
    if week is not None:
        return rows.where(F.col(name) == F.lit(week))
    return rows.join(F.broadcast(rows.agg(F.max(name).alias(name))), name)


def coverage(rows: DataFrame, *, week: datetime.date | None = None, family: int | None = None, state: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(optional(at_week(rows, week), family=family, state=state), [F.col("genre")], limit, offset)


def forecasts(rows: DataFrame, *, axis: str, horizon: int, genre=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Forecasts of the latest origin that fits, by category and model."""
    return page(at_week(optional(rows, axis=axis, horizon=horizon, genre=genre), name="origin"), [F.col("genre"), F.col("model")], limit, offset)


def macro_families(rows: DataFrame, *, family: int | None = None, weeks: int = 52) -> DataFrame:
    """Every family's latest weeks, or one family's."""
    if not 1 <= weeks <= 260:
        raise ValueError("1 to 260 weeks are expected")
    return first_by(optional(rows, family=family), ["family"], [F.col("week").desc()], weeks)
