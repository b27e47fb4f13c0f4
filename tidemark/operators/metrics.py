"""Composite metrics: maturity, indices, claims, trends, ecosystem, coverage and publishing.

A claim is only made where all of its evidence is there; whatever is missing stays NULL through every step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.sources.tables import settled


def dense(weeks: DataFrame, categories: DataFrame) -> DataFrame:
    """Every week with every category. Categories are a dimension table: its rows are few by definition."""
    return weeks.crossJoin(F.broadcast(categories))


def axis_maturity(grid: DataFrame, posts: DataFrame, pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds conversation_done (some posts, all mature), listening_done (a valid pair), supply_done (the week lies in a
    collected window) and state, which names the first axis that is not done."""
    keys = ["week", "genre"]
    conv = posts.groupBy(*keys).agg(F.bool_and("mature").alias("conversation_done"))
    heard = pairs.where("status = 'valid_weekly'").groupBy(*keys).agg(F.lit(True).alias("listening_done"))
    # windows contain weeks: weeks and windows are both few, one row a week and a run
    closed = grid.select("week").distinct().join(F.broadcast(windows), (F.col("from") <= F.col("week")) & (F.col("to") >= F.date_add("week", 6)), "left_semi").withColumn("supply_done", F.lit(True))
    out = grid.join(conv, keys, "left").join(heard, keys, "left").join(closed, "week", "left").na.fill(False, ["conversation_done", "listening_done", "supply_done"])
    state = F.when(~F.col("conversation_done"), "conversation_pending").when(~F.col("listening_done"), "listening_pending").when(~F.col("supply_done"), "supply_pending").otherwise("complete")
    return out.withColumn("state", state)


def indices(grid: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds conversation, listening and supply index: shrunk counts (conversation fitted on doubled scores), their
    logarithms, standardised within the group; listening is standardised as observed."""
    df = K.beta_binomial(grid.withColumn("_c2", 2 * F.col("conv")), "_c2", by, "_c_").withColumn("_c", F.ln(1 + F.col("_c_posterior_count") / 2))
    df = K.gamma_poisson(df, "releases", by, "_s_").withColumn("_s", F.ln(1 + F.col("_s_posterior"))).withColumn("_l", F.ln(1 + F.col("listen")))
    for value, name in (("_c", "conversation_index"), ("_l", "listening_index"), ("_s", "supply_index")):
        df = K.zscores(df, value, by, name)
    return df.select(*grid.columns, "conversation_index", "listening_index", "supply_index")


def claims(df: DataFrame, ready: Column) -> DataFrame:
    """Adds demand, opportunity (demand - supply) and gap (listening - conversation), where ready."""
    demand = (F.col("conversation_index") + F.col("listening_index")) / 2
    return df.withColumn("demand", F.when(ready, demand)).withColumn("opportunity", F.when(ready, demand - F.col("supply_index"))).withColumn("gap", F.when(ready, F.col("listening_index") - F.col("conversation_index")))


def estimates(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long form: (keys, context, metric, value); metrics that end in _peer belong to the family context."""
    long = df.unpivot(list(keys), list(metrics), "metric", "value")
    peer = F.col("metric").endswith("_peer")
    return long.select(*keys, F.when(peer, "peer_family").otherwise("global").alias("context"), F.regexp_replace("metric", "_peer$", "").alias("metric"), "value")


def families(df: DataFrame, value: str) -> DataFrame:
    """Family sums of eligible rows, standardised among the families of a week."""
    total = df.where("eligible").groupBy("week", "family").agg(F.sum(value).alias("total"), F.count(value).alias("members"))
    return K.zscores(total.withColumn("_x", F.ln(1 + F.col("total"))), "_x", ["week"], "index").drop("_x")


def eligibility(rules: Sequence[tuple[Column, str]]) -> Column:
    """The state of the first rule that applies, else ready."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, state in rules[1:]:
        out = out.when(condition, state)
    return out.otherwise("ready")


def history(df: DataFrame, by: Sequence[str], week: str, weeks: int) -> DataFrame:
    """Adds how many of the last `weeks` calendar weeks, this one included, have a row."""
    w = Window.partitionBy(*by).orderBy(F.datediff(F.col(week), F.lit("1970-01-05").cast("date"))).rangeBetween(-7 * (weeks - 1), 0)
    return df.withColumn("history", F.count(F.lit(1)).over(w))


def promotion(ready: DataFrame, published: DataFrame, as_of: Column) -> DataFrame:
    """(eligible, published, promote): the latest ready week that is closed at as_of, and whether it is news."""
    latest = ready.where(F.date_add("week", 7) <= as_of).agg(F.max("week").alias("eligible"))
    before = published.agg(F.max("week").alias("published"))
    news = F.col("eligible").isNotNull() & (F.col("published").isNull() | (F.col("eligible") > F.col("published")))
    return latest.crossJoin(before).withColumn("promote", news)


def publish(rows: DataFrame, path: str, version: str, violations: DataFrame) -> bool:
    """Writes the partition of a version, if no violation is counted; other versions stay as they are."""
    if sum(violations.first()):
        return False
    rows.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)
    return True


#: Units whose draws a task holds at once; cells that it gives out at once.
UNITS, GIVEN = 1024, 1024


def _codes(key: pa.StructArray) -> np.ndarray:
    """A number for each row's key, equal within the batch where keys are."""
    out = np.zeros(len(key), np.int64)
    for column in key.flatten():
        own = column.dictionary_encode()
        out = np.unique(out * (len(own.dictionary) + 1) + own.indices.fill_null(-1).to_numpy(zero_copy_only=False) + 1, return_inverse=True)[1]
    return out


def _given(keys: pa.StructArray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(keys), GIVEN):
        own = sums[lo : lo + GIVEN]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * sums.shape[1]), pa.array(own.ravel()))
        yield pa.RecordBatch.from_arrays([keys.slice(lo, GIVEN), lists], ["key", "sums"])


def resampled_sums(units: DataFrame, keys: Sequence[str], unit: Column, weight: Column, draws: int) -> DataFrame:
    """(keys, sums): the cells' sums in each draw of a Poisson bootstrap of their units, as an array, by the units' own numbers.

    A unit is never copied: tasks sort their units by cell and add all draws of a cell up in one array; the arrays are dealt
    by cell and summed. A task holds one cell's sums from batch to batch. Weights that are not there count as 0.
    """
    own = units.select(F.struct(*keys).alias("key"), unit.cast("string").alias("unit"), F.coalesce(weight.cast("double"), F.lit(0.0)).alias("weight"))

    def runs(batch: pa.RecordBatch) -> np.ndarray:
        return np.flatnonzero(np.r_[True, np.diff(_codes(batch["key"])) != 0])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, np.ndarray]]:
        for batch in batches:
            for lo in range(0, batch.num_rows, UNITS):
                part = batch.slice(lo, UNITS)
                first = runs(part)
                times = K.draws_of(part["unit"].to_pylist(), draws) * part["weight"].to_numpy()[:, None]
                yield part["key"].take(pa.array(first)), np.add.reduceat(times, first)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, np.ndarray]]:
        for batch in batches:
            if batch.num_rows:
                first = runs(batch)
                yield batch["key"].take(pa.array(first)), np.add.reduceat(batch["sums"].flatten().to_numpy().reshape(-1, draws), first)

    def joined(parts: Iterator[tuple[pa.StructArray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        # the last cell of a part may go on in the next
        last, held = None, None
        for key, sums in parts:
            if last is not None:
                if last.to_pylist() == key.slice(0, 1).to_pylist():
                    sums[0] += held[0]
                else:
                    yield from _given(last, held)
            yield from _given(key.slice(0, len(key) - 1), sums[:-1])
            last, held = key.slice(len(key) - 1), sums[-1:].copy()
        if last is not None:
            yield from _given(last, held)

    kind = f"key {own.schema['key'].dataType.simpleString()}, sums array<double>"
    partial = own.sortWithinPartitions("key").mapInArrow(lambda batches: joined(drawn(batches)), kind)
    whole = partial.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: joined(dealt(batches)), kind)
    return whole.select("key.*", "sums")


def resampled(units: DataFrame, keys: Sequence[str], unit: Column, weight: Column, draws: int) -> DataFrame:
    """(keys, k, value): resampled_sums with a row a draw."""
    return resampled_sums(units, keys, unit, weight, draws).select(*keys, F.posexplode("sums").alias("k", "value"))


def redrawn(cells: dict[str, DataFrame], grid: DataFrame, keys: Sequence[str], draws: int) -> DataFrame:
    """The grid once for each draw, with every axis's value (name: resampled_sums' frame) in it; NULL where the grid has
    none, 0 where a draw took no unit. Cells meet before they are multiplied by the draws."""
    out = grid
    for name, drawn in cells.items():
        out = out.join(drawn.withColumnRenamed("sums", f"_{name}"), [*keys], "left")
    out = out.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    for name in cells:
        out = out.withColumn(name, F.when(F.col(name).isNotNull(), F.coalesce(F.col(f"_{name}")[F.col("k")], F.lit(0.0))))
    return out.drop(*(f"_{name}" for name in cells))


def banded(points: DataFrame, drawn: DataFrame, keys: Sequence[str], names: Sequence[str], confidence: float = 0.9) -> DataFrame:
    """(keys, metric, value, lower, upper): each metric's point with the quantiles of its draws, widened to hold it. A band
    is made only where point and draws are there."""
    long = lambda df, *more: df.unpivot([*keys, *more], list(names), "metric", "value").where(F.col("value").isNotNull())
    samples = long(drawn, "k").withColumnRenamed("value", "_s")
    own = long(points).join(samples, [*keys, "metric"]).groupBy(*keys, "metric", "value").agg(K.interval(F.col("_s"), F.col("value"), confidence).alias("_i"))
    return own.select(*keys, "metric", "value", "_i.lower", "_i.upper")


CONTEXTS = ("global", "peer_family")
METRICS = ("conversation", "listening", "supply", "opportunity", "gap")


def wide_contexts(grid: DataFrame, by: Sequence[str] = ("week",)) -> DataFrame:
    """(by, genre, family, context, scope, METRICS): five metrics of the eligible cells (all three axes there), in comparison
    with all categories and with those of the family. by is the week, or the week and a draw.

    Counts are shrunk in two levels, categories within families, and standardised within `by`, or `by` and family.
    scope is the group that a cell is compared in: the family, or -1.
    """
    by = list(by)
    own = grid.where("conv is not null and listen is not null and releases is not null").select(*by, "genre", "family", "conv", "listen", "releases")
    own = K.hierarchical_beta_binomial(own.withColumn("_c2", 2 * F.col("conv")), "_c2", by, "family").withColumn("_c", F.ln(1 + F.col("posterior_count") / 2)).drop("posterior", "posterior_count", "weight")
    own = K.hierarchical_gamma_poisson(own, "releases", by, "family").withColumn("_s", F.ln(1 + F.col("posterior"))).withColumn("_l", F.ln(1 + F.col("listen")))
    if len(by) > 1:  # draws are many rows: both contexts read what was shrunk once
        own, _ = settled(own.select(*by, "genre", "family", "_c", "_l", "_s"), "drawn")
    out = None
    for context, among, scope in zip(CONTEXTS, (by, [*by, "family"]), (F.lit(-1), F.col("family")), strict=True):
        df = own
        for value, name in (("_c", "conversation"), ("_l", "listening"), ("_s", "supply")):
            df = K.zscores(df, value, among, name)
        df = df.withColumn("opportunity", (F.col("conversation") + F.col("listening")) / 2 - F.col("supply")).withColumn("gap", F.col("listening") - F.col("conversation"))
        df = df.select(*by, "genre", "family", F.lit(context).alias("context"), scope.cast("int").alias("scope"), *METRICS)
        out = df if out is None else out.unionByName(df)
    return out


def in_contexts(grid: DataFrame) -> DataFrame:
    """(week, genre, family, context, scope, metric, value): wide_contexts in long form."""
    return wide_contexts(grid).unpivot(["week", "genre", "family", "context", "scope"], list(METRICS), "metric", "value")


def banded_contexts(grid: DataFrame, drawn: DataFrame, confidence: float = 0.9) -> DataFrame:
    """(week, genre, context, metric, value, lower, upper): every metric of wide_contexts with the quantiles of its draws
    (redrawn's grid), which are shrunk and standardised anew in both contexts; the band holds the value."""
    keys = ["week", "genre", "context"]
    lo, hi = (1 - confidence) / 2, (1 + confidence) / 2
    quantiles = wide_contexts(drawn, ["week", "k"]).groupBy(*keys).agg(*(F.percentile(m, F.array(F.lit(lo), F.lit(hi))).alias(f"_{m}") for m in METRICS))
    both = wide_contexts(grid).join(quantiles, keys)
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.least(F.col(m), F.col(f"_{m}")[0]).alias("lower"), F.greatest(F.col(m), F.col(f"_{m}")[1]).alias("upper")) for m in METRICS))).alias("r")
    return both.select(*keys, rows).select(*keys, "r.*").where("value is not null")


def macro_scopes(grid: DataFrame, by: Sequence[str] = ("week",)) -> DataFrame:
    """The grid with families in place of categories (genre and family are the family): sums of the axes of the cells that
    have all three, so that wide_contexts compares families with each other."""
    own = grid.where("conv is not null and listen is not null and releases is not null")
    own = own.groupBy(*by, "family").agg(F.sum("conv").alias("conv"), F.sum("listen").alias("listen"), F.sum("releases").alias("releases")).withColumn("genre", F.col("family"))
    return settled(own, "macro")[0] if len(by) > 1 else own


def followed(long: DataFrame) -> DataFrame:
    """Adds to in_contexts' rows their trend, and whether they leave it by far (spike): residuals are compared within the
    week, metric and scope."""
    keys = ["genre", "context", "metric"]
    return K.spikes(K.ewma(long, "value", keys, "week", out="trend"), "value", "trend", ["week", "context", "scope", "metric"])


def breakouts_in_contexts(long: DataFrame) -> DataFrame:
    """(week, genre, context, breakout): listening in the upper tail of its scope while conversation is below its median."""
    keys = ["week", "genre", "context", "scope"]
    wide = long.where(F.col("metric").isin("conversation", "listening")).groupBy(*keys).agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("conversation", "listening")))
    return K.breakouts(wide, "listening", "conversation", ["week", "context", "scope"]).select("week", "genre", "context", "breakout")
