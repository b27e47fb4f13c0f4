"""Statistical kernels over observation frames: one row for each (period, category), NULL where there is no evidence.

All variances are those of populations. NULL in means NULL out: nothing that is missing is counted as zero. Kernels are
windows and aggregations over the given group columns, so that they partition by period; none gathers rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON, MOST = 1e-12, 1e6


def over(by: Sequence[str]):
    return Window.partitionBy(*by)


def zscores(df: DataFrame, value: str, by: Sequence[str], out: str = "z") -> DataFrame:
    """Adds the z-score of value within its group, centred again; 0 where the group does not vary."""
    w = over(by)
    spread = F.stddev_pop(value).over(w)
    raw = F.when(F.col(value).isNull(), None).when(spread <= EPSILON, 0.0).otherwise(F.try_divide(F.col(value) - F.avg(value).over(w), spread))
    df = df.withColumn("_raw", raw)
    return df.withColumn(out, F.col("_raw") - F.avg("_raw").over(w)).drop("_raw")


def _clip(x: Column, lo: float = EPSILON, hi: float = MOST) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def beta_binomial(df: DataFrame, count: str, by: Sequence[str], prefix: str = "") -> DataFrame:
    """Adds posterior (share), posterior_count and weight (of the prior) for counts that share their group's total.

    The prior is 1 / group size; its concentration is fitted by moments from the spread of observed shares.
    """
    w = over(by)
    df = df.withColumn("_t", F.sum(count).over(w)).withColumn("_g", F.count(count).over(w).cast("double"))
    df = df.withColumn("_s", F.when(F.col("_t") > EPSILON, F.col(count) / F.nullif(F.col("_t"), F.lit(0.0))))
    df = df.withColumn("_v", F.var_pop("_s").over(w))
    p = 1.0 / F.nullif(F.col("_g"), F.lit(0.0))
    latent = F.greatest(F.col("_v") - p * (1 - p) / F.nullif(F.col("_t"), F.lit(0.0)), F.lit(EPSILON))
    c = _clip(p * (1 - p) / latent - 1)
    some = F.col("_t") > EPSILON
    known = F.col(count).isNotNull()
    posterior = F.when(known, F.when(some, (F.col(count) + p * c) / (F.col("_t") + c)).otherwise(p))
    weight = F.when(known, F.when(some, c / (F.col("_t") + c)).otherwise(1.0))
    df = df.withColumn(f"{prefix}posterior", posterior).withColumn(f"{prefix}posterior_count", F.when(known, F.when(some, posterior * F.col("_t")).otherwise(0.0))).withColumn(f"{prefix}weight", weight)
    return df.drop("_t", "_g", "_s", "_v")


def gamma_poisson(df: DataFrame, count: str, by: Sequence[str], prefix: str = "", mean: Column | None = None) -> DataFrame:
    """Adds posterior and weight of counts shrunk to their group's mean (or to `mean`), by a moment-fitted gamma prior."""
    w = over(by)
    df = df.withColumn("_m", mean if mean is not None else F.avg(count).over(w)).withColumn("_v", F.var_pop(count).over(w))
    m, v = F.col("_m"), F.col("_v")
    shape = _clip(F.when(v > m + EPSILON, m * m / F.nullif(v - m, F.lit(0.0))).otherwise(F.lit(MOST)))
    rate = shape / F.nullif(m, F.lit(0.0))
    known, some = F.col(count).isNotNull(), m > EPSILON
    df = df.withColumn(f"{prefix}posterior", F.when(known, F.when(some, (F.col(count) + shape) / (1 + rate)).otherwise(0.0)))
    df = df.withColumn(f"{prefix}weight", F.when(known, F.when(some, rate / (1 + rate)).otherwise(1.0)))
    return df.drop("_m", "_v")


def hierarchical_beta_binomial(df: DataFrame, count: str, by: Sequence[str], family: str) -> DataFrame:
    """Shares of families are shrunk among families, shares within a family among its members; their product is the
    posterior. Adds posterior, posterior_count and weight (that either prior contributes)."""
    keys = [*by, family]
    families = beta_binomial(df.groupBy(*keys).agg(F.sum(count).alias("_f")), "_f", by, "_f_").select(*keys, "_f_posterior", "_f_weight")
    df = beta_binomial(df, count, keys, "_w_").join(families, keys)
    total = F.sum(count).over(over(by))
    df = df.withColumn("posterior", F.col("_f_posterior") * F.col("_w_posterior")).withColumn("weight", 1 - (1 - F.col("_w_weight")) * (1 - F.col("_f_weight")))
    return df.withColumn("posterior_count", F.col("posterior") * total).drop("_f_posterior", "_f_weight", "_w_posterior", "_w_posterior_count", "_w_weight")


def hierarchical_gamma_poisson(df: DataFrame, count: str, by: Sequence[str], family: str) -> DataFrame:
    """Family means are shrunk among families; a family's posterior is its members' prior mean. Adds posterior, weight."""
    keys = [*by, family]
    families = gamma_poisson(df.groupBy(*keys).agg(F.avg(count).alias("_f")), "_f", by, "_f_").select(*keys, "_f_posterior", F.col("_f_weight"))
    df = gamma_poisson(df.join(families, keys), count, keys, "_w_", F.col("_f_posterior"))
    return df.withColumn("posterior", F.col("_w_posterior")).withColumn("weight", 1 - (1 - F.col("_w_weight")) * (1 - F.col("_f_weight"))).drop("_f_posterior", "_f_weight", "_w_posterior", "_w_weight")


def kish(weight: Column) -> Column:
    """Aggregate: (sum w)^2 / sum w^2, the effective number of units; 0 when there is no weight."""
    s, q = F.sum(weight), F.sum(weight * weight)
    return F.coalesce(F.when((s > EPSILON) & (q > EPSILON), s * s / F.nullif(q, F.lit(0.0))), F.lit(0.0))


def concentration(df: DataFrame, value: str, by: Sequence[str], k: int, tie: str) -> DataFrame:
    """(by, entropy, hhi, top_share): of the non-negative values of each group; 0 for an empty or zero total."""
    df = df.where(F.col(value).isNotNull())
    w = over(by)
    df = df.withColumn("_t", F.sum(value).over(w)).withColumn("_p", F.when(F.col("_t") > 0, F.col(value) / F.nullif(F.col("_t"), F.lit(0.0))).otherwise(0.0))
    df = df.withColumn("_r", F.row_number().over(w.orderBy(F.col(value).desc(), tie)))
    p = F.col("_p")
    return df.groupBy(*by).agg(F.sum(F.when(p > 0, -p * F.ln(p)).otherwise(0.0)).alias("entropy"), F.sum(p * p).alias("hhi"), F.sum(F.when(F.col("_r") <= k, p).otherwise(0.0)).alias("top_share"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 for two empty ones, NULL if either is NULL."""
    union = F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull(), None).when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def ewma(df: DataFrame, value: str, by: Sequence[str], time: str, half_life: float = 3.0, out: str = "ewma") -> DataFrame:
    """Adds the exponentially weighted mean along time; a missing value gives NULL and leaves the state as it was.

    The series of one key is folded as an array: its length is the number of periods.
    """
    alpha = 1 - math.exp(math.log(0.5) / half_life)
    step = lambda acc, x: F.struct(
        F.when(x["v"].isNull(), acc["s"]).when(acc["s"].isNull(), x["v"]).otherwise(alpha * x["v"] + (1 - alpha) * acc["s"]).alias("s"),
        F.concat(acc["o"], F.array(F.struct(x["t"].alias("t"), F.when(x["v"].isNull(), None).when(acc["s"].isNull(), x["v"]).otherwise(alpha * x["v"] + (1 - alpha) * acc["s"]).alias("e")))).alias("o"),
    )
    kind = df.schema[time].dataType.simpleString()
    start = F.struct(F.lit(None).cast("double").alias("s"), F.array().cast(f"array<struct<t:{kind},e:double>>").alias("o"))
    series = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v")))).alias("x"))
    folded = series.select(*by, F.explode(F.aggregate("x", start, step, lambda acc: acc["o"])).alias("r")).select(*by, F.col("r.t").alias(time), F.col("r.e").alias(out))
    return df.join(folded, [*by, time])


def spikes(df: DataFrame, value: str, trend: str, by: Sequence[str], *, factor: float = 2.5, least: int = 2, out: str = "spike") -> DataFrame:
    """Adds whether value - trend exceeds factor times its group's deviation; NULL without value."""
    df = df.withColumn("_r", F.col(value) - F.col(trend))
    w = over(by)
    wide = F.stddev_pop("_r").over(w)
    flag = F.when(F.col("_r").isNull(), None).otherwise(F.coalesce((F.count("_r").over(w) >= least) & (wide > EPSILON) & (F.col("_r") > factor * wide), F.lit(False)))
    return df.withColumn(out, flag).drop("_r")


def breakouts(df: DataFrame, strong: str, quiet: str, by: Sequence[str], *, level: float = 0.9, out: str = "breakout") -> DataFrame:
    """Adds whether strong is in its group's upper tail while quiet is below its median; thresholds of observed rows."""
    limits = df.groupBy(*by).agg(F.expr(f"percentile({strong}, {level})").alias("_hi"), F.expr(f"percentile({quiet}, 0.5)").alias("_mid"))
    return df.join(limits, list(by)).withColumn(out, (F.col(strong) >= F.col("_hi")) & (F.col(quiet) < F.col("_mid"))).drop("_hi", "_mid")


def interval(samples: Column, point: Column, confidence: float = 0.9) -> Column:
    """Aggregate: struct(lower, upper) of samples' quantiles, widened to hold the point; NULL without point."""
    lo, hi = (1 - confidence) / 2, (1 + confidence) / 2
    q = F.percentile(samples, F.array(F.lit(lo), F.lit(hi)))
    return F.when(point.isNull(), None).otherwise(F.struct(F.least(q[0], point).alias("lower"), F.greatest(q[1], point).alias("upper")))


def counter_status(week: Column, last_week: Column, now: Sequence[Column], before: Sequence[Column], *, append_only: Column | None = None, at: Column | None = None, last_at: Column | None = None) -> Column:
    """How two readings of cumulative counters relate; the first that applies."""
    absent = lambda cols: [c.isNull() for c in cols]
    every = lambda flags: _fold(flags, lambda a, b: a & b)
    some = lambda flags: _fold(flags, lambda a, b: a | b)
    status = F.when(last_week.isNull() & every(absent(before)), "first_observation").when(last_week.isNull() | some(absent([*now, *before])), "incomplete_pair")
    if append_only is not None:
        status = status.when(~append_only, "not_append_only")
    if at is not None and last_at is not None:
        status = status.when(at <= last_at, "invalid_order")
    status = status.when(week == last_week, "same_week_duplicate").when(F.datediff(week, last_week) != 7, "nonconsecutive_weeks")
    return status.when(some([a < b for a, b in zip(now, before, strict=True)]), "counter_decrease").otherwise("valid_weekly")


def _fold(flags: list[Column], f) -> Column:
    out = flags[0]
    for x in flags[1:]:
        out = f(out, x)
    return out


def cosine(a: Column, b: Column) -> Column:
    """Of two numeric arrays; 0 if a norm is 0, NULL if lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), None).when(norms <= EPSILON, 0.0).otherwise(dot(a, b) / F.nullif(norms, F.lit(0.0)))


def islands(df: DataFrame, by: Sequence[str], week: str, out: str = "run") -> DataFrame:
    """Adds the first week of the unbroken run of weeks that a row belongs to."""
    w = Window.partitionBy(*by).orderBy(week)
    key = F.date_sub(F.col(week), F.row_number().over(w) * 7)
    df = df.withColumn("_k", key)
    return df.withColumn(out, F.min(week).over(Window.partitionBy(*by, "_k"))).drop("_k")


def draw(unit: Column, number: Column) -> Column:
    """A uniform number in [0, 1) from the md5 of a unit and a fourth of a draw's number: equal everywhere and on every
    run. A digest's 32 digits make four draws."""
    digest = F.md5(F.concat_ws(":", unit.cast("string"), F.floor(number / 4).cast("string")))
    return F.conv(digest.substr((number % 4 * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("double") / 4294967296.0


#: md5's additive constants and rotations (RFC 1321); units that are digested together.
MD5_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
MD5_TURNS = [r for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for r in four]
DIGESTED = 256


def _digests(blocks: np.ndarray) -> np.ndarray:
    """(n, 4) big-endian words of the md5 of padded messages of one block: blocks holds its 16 words, a row each of n
    messages, or of one number where a word is the same for all."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    n = max(len(b) for b in blocks)
    a, b, c, d = (np.full(n, x, np.uint32) for x in start)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = blocks[(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16]
        f += a
        f += word + np.uint32(MD5_ADDED[i])
        np.left_shift(f, np.uint32(MD5_TURNS[i]), out=g), np.right_shift(f, np.uint32(32 - MD5_TURNS[i]), out=f)
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a
    return np.stack([x + y for x, y in zip((a, b, c, d), start, strict=True)], axis=1).byteswap()


def _numbers(units: Sequence[str], many: int) -> np.ndarray:
    """(units, 4 * many): the words of the md5 of each unit with each number below `many`. Messages of one block are digested
    together by length, longer ones one by one."""
    plain = [u.encode() for u in units]
    lengths = np.fromiter(map(len, plain), np.int64, len(plain))
    out = np.empty((len(plain), many, 4), np.uint32)
    tails = [f":{k}".encode() for k in range(many)]
    for length in np.unique(lengths):
        of = np.flatnonzero(lengths == length)
        for size in sorted({len(t) for t in tails}):
            these = [k for k in range(many) if len(tails[k]) == size]
            whole = int(length) + size
            if whole > 55:
                digests = b"".join(hashlib.md5(plain[i] + tails[k], usedforsecurity=False).digest() for i in of for k in these)
                out[of[:, None], these] = np.frombuffer(digests, ">u4").reshape(len(of), len(these), 4)
                continue
            # the number, the end and the length, which all units share; bytes of unit and tail do not overlap
            tail = np.zeros((len(these), 64), np.uint8)
            tail[:, length:whole] = np.frombuffer(b"".join(tails[k] for k in these), np.uint8).reshape(len(these), size)
            tail[:, whole] = 0x80
            tail = tail.view("<u4")
            for lo in range(0, len(of), DIGESTED):
                rows = of[lo : lo + DIGESTED]
                head = np.zeros((len(rows), 64), np.uint8)
                head[:, :length] = np.frombuffer(b"".join(plain[i] for i in rows), np.uint8).reshape(len(rows), length)
                head = head.view("<u4")
                words = [(head[:, i, None] | tail[None, :, i]).ravel() for i in range(whole // 4 + 1)]
                words += [np.array([x], np.uint32) for x in [0] * (14 - len(words)) + [8 * whole, 0]]
                out[rows[:, None], these] = _digests(words).reshape(len(rows), len(these), 4)
    return out.reshape(len(plain), 4 * many)


def draws_of(units: Sequence[str], draws: int) -> np.ndarray:
    """How often each unit is drawn in each draw of a Poisson bootstrap (a row a unit): poisson_one of draw."""
    numbers = _numbers(units, -(-draws // 4))[:, :draws]
    # number / 2^32 reaches a level where the number reaches the level's multiple, rounded up
    times = np.zeros(numbers.shape, np.int8)
    for level in POISSON_LEVELS:
        times += numbers >= np.uint32(math.ceil(level * 4294967296))
    return times


def _levels(most: int) -> list[float]:
    total, out = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
    return out


POISSON_LEVELS = _levels(6)


def poisson_one(u: Column) -> Column:
    """The Poisson(1) quantile of a uniform number: how often a unit is drawn in a Poisson bootstrap, 6 at most."""
    out = F.lit(len(POISSON_LEVELS))
    for k, level in reversed(list(enumerate(POISSON_LEVELS))):
        out = F.when(u < level, F.lit(k)).otherwise(out)
    return out
