"""Experiment statistics.

Counting and moments are distributed aggregates; the closed-form statistics
are then evaluated as column expressions on the few aggregated rows. The
normal tail is a built-in-function polynomial, so no Python runs in the job;
``p_value_udf`` is the exact (math.erfc) Pandas UDF for callers who want it.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Coefficients of the complementary error function
# approximation erfc(x) ~ t * exp(-x^2 + P(t)), t = 1 / (1 + x / 2), for
# x >= 0 (Numerical Recipes "erfcc"; fractional error below 1.2e-7).
# P(t) coefficients, constant term first:
ERFC_COEFFS = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
               0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc_expr(x: Column) -> Column:
    """erfc(|x|) from built-in functions (JVM side)."""
    ax = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * ax)
    poly = F.lit(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-ax * ax + poly)


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value: erfc(|z| / sqrt 2)."""
    return erfc_expr(z / math.sqrt(2.0))


@F.pandas_udf(T.DoubleType())
def p_value_udf(z: pd.Series) -> pd.Series:
    """Exact two-sided normal p-value (Arrow-batched Pandas UDF, P75)."""
    return z.abs().div(math.sqrt(2.0)).map(math.erfc)


def converted_within(ts: str, event_col: str, conversion: str, within: str | None) -> Column:
    """Per-unit aggregate: 1 when the unit has a ``conversion`` event (within
    ``within`` of its first event, when given), else 0."""
    first_conv = F.min(F.when(F.col(event_col) == conversion, F.col(ts)))
    if within is None:
        hit = first_conv.isNotNull()
    else:
        hit = first_conv <= F.min(ts) + F.expr(f"INTERVAL {within}")
    return F.when(hit, 1).otherwise(0)


def ab_counts(df: DataFrame, unit: str, group: Column, conv_agg: Column) -> DataFrame:
    """Exposed units, converted units and conversion rate per group; ``conv_agg``
    is a per-unit aggregate giving 0/1 (see ``converted_within``). Units are
    reduced first (one partial aggregate), so a heavy unit costs one row."""
    per_unit = df.groupBy(unit).agg(conv_agg.alias("_conv"))
    return (per_unit.withColumn("grp", group)
            .groupBy("grp").agg(F.count(F.lit(1)).alias("n_users"),
                                F.sum("_conv").cast("long").alias("n_converted"))
            .withColumn("rate", F.col("n_converted") / F.col("n_users")))


def z_test(counts: DataFrame, a, b) -> DataFrame:
    """Two-proportion z test between groups ``a`` and ``b`` of ``ab_counts``."""
    def pick(c, g):
        return F.max(F.when(F.col("grp") == g, F.col(c)))
    one = counts.agg(pick("n_users", a).alias("n_a"), pick("n_converted", a).alias("x_a"),
                     pick("n_users", b).alias("n_b"), pick("n_converted", b).alias("x_b"))
    pa, pb = F.col("x_a") / F.col("n_a"), F.col("x_b") / F.col("n_b")
    pool = (F.col("x_a") + F.col("x_b")) / (F.col("n_a") + F.col("n_b"))
    se = F.sqrt(pool * (1 - pool) * (1 / F.col("n_a") + 1 / F.col("n_b")))
    return (one.withColumn("rate_a", pa).withColumn("rate_b", pb)
               .withColumn("diff", pb - pa)
               .withColumn("z", F.when(se > 0, (pb - pa) / se))
               .withColumn("p_value", two_sided_p(F.col("z"))))


def welch_test(df: DataFrame, group: Column, value: str, a, b) -> DataFrame:
    """Welch's t statistic and Welch-Satterthwaite degrees of freedom; null
    where the groups do not vary or one has a single value."""
    g = df.select(group.alias("grp"), F.col(value).alias("_v"))
    m = g.groupBy("grp").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"),
                             F.var_samp("_v").alias("var"))

    def pick(c, k):
        return F.max(F.when(F.col("grp") == k, F.col(c)))
    one = m.agg(*[pick(c, k).alias(f"{c}_{s}") for c in ("n", "mean", "var") for k, s in ((a, "a"), (b, "b"))])
    va, vb = F.try_divide("var_a", "n_a"), F.try_divide("var_b", "n_b")
    return (one.withColumn("t", F.try_divide(F.col("mean_b") - F.col("mean_a"), F.sqrt(va + vb)))
               .withColumn("dof", F.try_divide((va + vb) * (va + vb), F.try_divide(va * va, F.col("n_a") - 1)
                                               + F.try_divide(vb * vb, F.col("n_b") - 1))))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson chi-square of independence between ``a`` and ``b``.

    Only observed cells are materialised: the empty cells contribute their
    expected counts, whose total is N minus the expected counts of the
    observed cells, so no (levels x levels) grid is built. Cells are counted once
    and the margins are windows over them. Rows with a null in either take no part."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    n = cells.select(F.sum("o")).scalar()
    by_a, by_b = Window.partitionBy(a), Window.partitionBy(b)  # over cells: a window holds one level's cells, not its rows
    each = cells.select("o", F.sum("o").over(by_a).alias("ra"), F.count(F.lit(1)).over(by_a).alias("ka"),
                        F.sum("o").over(by_b).alias("cb"), F.count(F.lit(1)).over(by_b).alias("kb"))
    each = each.withColumn("e", F.col("ra") * F.col("cb") / n)
    stat = each.agg(F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("_obs"), F.sum("e").alias("_se"), F.sum("o").alias("n"),
                    F.round(F.sum(1 / F.col("ka"))).alias("levels_a"), F.round(F.sum(1 / F.col("kb"))).alias("levels_b"))
    return stat.select((F.col("_obs") + F.col("n") - F.col("_se")).alias("chi2"),
                       ((F.col("levels_a") - 1) * (F.col("levels_b") - 1)).cast("long").alias("dof"),
                       F.col("n").cast("long").alias("n"))


def sample_ratio_check(df: DataFrame, unit: str, group: Column,
                       expected: dict[object, float]) -> DataFrame:
    """Observed units per group against expected shares: per-group rows with
    the expected count and the goodness-of-fit chi-square over all groups."""
    units = df.select(unit).distinct().withColumn("grp", group)
    obs = units.groupBy("grp").agg(F.count(F.lit(1)).alias("n_users"))
    share = F.lit(None).cast("double")
    for g, s in expected.items():
        share = F.when(F.col("grp") == g, F.lit(float(s))).otherwise(share)
    total = obs.select(F.sum("n_users")).scalar()
    out = obs.withColumn("expected_users", share * total)
    chi = out.select(F.sum((F.col("n_users") - F.col("expected_users")) ** 2
                           / F.col("expected_users"))).scalar()
    return out.withColumn("chi2", chi)


_EXACT_TABLE = 10_000  # counts up to here draw from a table of the distribution, larger ones from numpy's sampler


@lru_cache(256)
def _poisson_cdf(n: int):
    """P(X <= k) for Poisson(n), for k from 0 until it is 1 in double precision."""
    import numpy as np

    k = np.arange(n + 12 * math.isqrt(n) + 40)
    log_p = k * math.log(n) - n - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(k))))])
    return np.minimum(np.cumsum(np.exp(log_p)), 1.0)


def _resampled(values, counts, reps: int, seed: int):
    """Weights (values x reps): Poisson(count) draws that hang on the value, the replicate and the seed alone."""
    import numpy as np

    def mix(x):  # splitmix64
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    odd = np.uint64(0x9E3779B97F4A7C15)
    own = mix(np.ascontiguousarray(values, "<f8").view(np.uint64) + mix(np.array([seed % 2**64], np.uint64) + odd))
    out = np.empty((len(values), reps))
    for n in np.unique(counts):
        rows = np.flatnonzero(counts == n)
        if n > _EXACT_TABLE:
            for i in rows:
                out[i] = np.random.Generator(np.random.Philox(key=int(own[i]))).poisson(n, reps)
            continue
        u = mix(own[rows, None] + odd * np.arange(1, reps + 1, dtype=np.uint64)) >> np.uint64(11)
        out[rows] = np.searchsorted(_poisson_cdf(int(n)), u * 2.0**-53, "right")
    return out


def bootstrap_mean_ci(df: DataFrame, value: str, reps: int = 200, seed: int = 7, conf: float = 0.95) -> DataFrame:
    """Bootstrap interval of the mean by Poisson resampling: mean, se (of the mean, from
    the sample variance), ci_lo, ci_hi, reps.

    Each row would get a Poisson(1) weight in each replicate; rows of one value
    together get a Poisson(count) weight, so the value histogram (a partial
    aggregate) is resampled instead of the rows. Each task adds up a vector of
    ``reps`` weighted sums over its part of the histogram, and only these vectors
    are put together. Draws are exact and hang on (value, replicate, seed) alone,
    so neither partitioning nor a rerun changes them. Nulls take no part; replicates
    whose weights are all 0 have no mean; without a value all results are null."""
    hist = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))

    def add_up(frames):
        import numpy as np
        import pandas as pd

        weights, sums, spread, any_ = np.zeros(reps + 1), np.zeros(reps + 1), 0.0, False
        for frame in frames:
            for lo in range(0, len(frame), 2000):  # 2000 x reps draws at a time
                v, n = frame["v"].to_numpy()[lo:lo + 2000], frame["n"].to_numpy()[lo:lo + 2000]
                w = np.column_stack([n, _resampled(v, n, reps, seed)])  # the sample itself is replicate 0
                mean = float(n @ v) / n.sum()
                apart = mean - sums[0] / weights[0] if any_ else 0.0
                spread += float(n @ (v - mean) ** 2) + apart**2 * weights[0] * n.sum() / (weights[0] + n.sum())
                weights += w.sum(axis=0)
                sums += v @ w
                any_ = True
        if any_:
            yield pd.DataFrame({"rep": range(reps + 1), "w": weights, "s": sums, "q": [spread] + [0.0] * reps})

    parts = hist.mapInPandas(add_up, "rep int, w double, s double, q double")
    own = F.col("rep") == 0
    per = parts.groupBy("rep").agg(F.sum("w").alias("w"), F.sum("s").alias("s"), F.collect_list(F.when(own, F.struct(
        "w", (F.col("s") / F.col("w")).alias("m"), "q"))).alias("parts"))  # one for each task
    lo, hi = (1 - conf) / 2, 1 - (1 - conf) / 2
    mean = F.try_divide(F.col("s"), F.col("w"))
    out = per.agg(F.max("parts").alias("parts"), *[  # over the replicates, a number that is given
        F.percentile(F.when(~own, mean), p).alias(c) for c, p in (("ci_lo", lo), ("ci_hi", hi))])
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def joined(a: Column, b: Column) -> Column:
        w, apart = a["w"] + b["w"], b["m"] - a["m"]
        return F.struct(w.alias("w"), (a["m"] + apart * b["w"] / w).alias("m"), (a["q"] + b["q"] + apart * apart * a["w"] * b["w"] / w).alias("q"))

    out = out.withColumn("all", F.aggregate(F.coalesce("parts", F.array().cast("array<struct<w:double,m:double,q:double>>")), zero, joined))
    n = F.col("all.w")
    return out.select(F.when(n > 0, F.col("all.m")).alias("mean"), F.sqrt(F.try_divide(F.col("all.q"), n * F.nullif(n - 1, F.lit(0.0)))).alias("se"),
                      "ci_lo", "ci_hi", F.lit(reps).alias("reps"))
