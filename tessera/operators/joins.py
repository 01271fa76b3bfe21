"""Joins (P20-P25): enrich, semi/anti, reconcile, tier (range), interval, as-of.

Time-ordered joins split each key's timeline into buckets of a chosen grain,
so a key holding a third of all rows is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def left_enrich(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """All rows of ``df``; columns of ``dim`` where the key matches, else null."""
    return df.join(dim, on=list(on), how="left")


def with_match(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows of ``df`` with at least one partner (EXISTS, left semi join)."""
    return df.join(other, on=on, how="left_semi")


def without_match(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows of ``df`` without a partner (NOT EXISTS, left anti join)."""
    return df.join(other, on=on, how="left_anti")


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Compare two cuts of one table by key: rows only in ``a``, only in ``b``,
    and rows whose ``cols`` differ (null-safe). Unchanged rows are dropped.

    Output: keys, ``status`` (only_a / only_b / changed), and for each column
    ``<col>_a``, ``<col>_b``."""
    keys, cols = list(keys), list(cols)
    aa = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in cols]).withColumn("_in_a", F.lit(True))
    bb = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in cols]).withColumn("_in_b", F.lit(True))
    j = aa.join(bb, on=keys, how="full_outer")
    same = None
    for c in cols:
        e = F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
        same = e if same is None else same & e
    status = (F.when(F.col("_in_b").isNull(), F.lit("only_a"))
               .when(F.col("_in_a").isNull(), F.lit("only_b"))
               .when(~same, F.lit("changed")))
    out = j.withColumn("status", status).where(F.col("status").isNotNull())
    return out.select(*keys, "status", *[x for c in cols for x in (f"{c}_a", f"{c}_b")])


def _ordered_type(df: DataFrame, value: str, ranges: DataFrame, lo: str, hi: str) -> T.DataType:
    """The type in which values and bounds are compared: the one Spark finds for all three, so whole numbers stay whole."""
    kinds = [df.schema[value].dataType, ranges.schema[lo].dataType, ranges.schema[hi].dataType]
    one = df.sparkSession.range(0).select(F.array(*[F.lit(None).cast(k) for k in kinds]).alias("all"))
    return one.schema["all"].dataType.elementType


def _checked_starts(ranges: DataFrame, lo: str, hi: str, kind: T.DataType, partitions: int | None) -> DataFrame:
    """Ranges by start: _lo, _hi, _r (the whole row); raises on null or empty ranges and on overlaps."""
    from tessera.operators.ordering import ranged

    typed = ranges.select(F.col(lo).cast(kind).alias("_lo"), F.col(hi).cast(kind).alias("_hi"), F.struct(*ranges.columns).alias("_r"))
    m = ranged(typed, ["_lo"], partitions)
    inside = Window.partitionBy("_pid").orderBy("_mid")
    follows = m.withColumn("_next", F.lead("_lo").over(inside))
    # one row per range partition: a proven bound
    ends = m.groupBy("_pid").agg(F.min("_lo").alias("_first"), F.max("_hi").alias("_last"))
    after = ends.withColumn("_next", F.min("_first").over(Window.orderBy("_pid").rowsBetween(1, Window.unboundedFollowing)))
    bad = follows.agg(F.count(F.when(F.col("_lo").isNull() | F.col("_hi").isNull(), 1)).alias("nulls"), F.count(F.when(F.col("_hi") <= F.col("_lo"), 1)).alias("empty"),
                      F.count(F.when(F.col("_next") < F.col("_hi"), 1)).alias("overlaps")).first()
    across = after.where(F.col("_next") < F.col("_last")).count()
    for what, n in (("with a null bound", bad["nulls"]), ("that end at or before their start", bad["empty"]), ("that overlap the next", bad["overlaps"] + across)):
        if n:
            raise ValueError(f"{n} ranges {what}")
    return m.select("_lo", "_hi", "_r")


def tier_join(df: DataFrame, value: str, tiers: DataFrame, lo: str = "lo", hi: str = "hi",
              partitions: int | None = None) -> DataFrame:
    """Attach the tier whose half-open range [lo, hi) holds ``value``; rows in no tier, or
    without a value, keep null tier columns. One way at every size: tier starts and
    distinct values (a partial aggregate, so a hot value is one row) are sorted together
    in range partitions, the last start at or before each value is carried by a
    window inside each partition and across partitions from a table of one row per
    partition, and the answer per distinct value is joined back to the rows.
    Comparison is in the type that Spark finds for the value and both bounds: whole
    numbers beyond 2 ** 53 stay apart. Null or empty ranges and overlaps raise."""
    from tessera.operators.ordering import ranged

    kind = _ordered_type(df, value, tiers, lo, hi)
    known = _checked_starts(tiers, lo, hi, kind, partitions)
    starts = known.select(F.col("_lo").alias("_k"), F.lit(0).alias("_kind"), F.struct("_hi", "_r").alias("_t"))
    vals = df.select(F.col(value).cast(kind).alias("_k")).where(F.col("_k").isNotNull()).distinct().select(
        "_k", F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_t"].dataType).alias("_t"))
    m = ranged(starts.unionByName(vals), ["_k", "_kind"], partitions)
    w = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    inside = m.withColumn("_in", F.last("_t", ignorenulls=True).over(w))
    per = m.groupBy("_pid").agg(F.max_by("_t", F.when(F.col("_t").isNotNull(), F.col("_mid"))).alias("_pl"))
    carry = per.select(F.col("_pid").alias("_cpid"), F.last("_pl", ignorenulls=True).over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_cy"))
    # one row per range partition: a proven bound
    hits = inside.where("_kind = 1").join(F.broadcast(carry), F.col("_pid") == F.col("_cpid"), "left").select("_k", F.coalesce("_in", "_cy").alias("_hit"))
    found = hits.where(F.col("_k") < F.col("_hit._hi")).select(F.col("_k").alias("_at"), *[
        F.col(f"_hit._r.`{c}`").alias(c) for c in tiers.columns if c not in (lo, hi)])
    return df.join(found, F.col(value).cast(kind) == F.col("_at"), "left").drop("_at")


def _micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch, linear in the column's own clock: wall
    clock for TIMESTAMP_NTZ (no zone conversion, so no DST jumps), the instant
    for TIMESTAMP."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(ts))
    return F.unix_micros(F.col(ts))


def _grain_micros(grain: str) -> int:
    n, unit = grain.split()
    mult = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
    return int(n) * mult[unit.rstrip("s")] * 1_000_000


def interval_join(a: DataFrame, b: DataFrame, key: str, a_ts: str, b_ts: str,
                  within: str, *, lower_inclusive: bool = True) -> DataFrame:
    """Pairs (x in a, y in b) with equal ``key`` and ``x.ts <= y.ts <= x.ts + within``.

    Both sides are keyed by (key, time bucket of width ``within``); each ``b``
    row is sent to its own bucket and the one before, so every matching pair
    meets in exactly one bucket and a hot key is split over its buckets.
    Column names of ``a`` and ``b`` must be distinct except ``key``."""
    g = _grain_micros(within)
    aa = a.withColumn("_am", _micros(a, a_ts)).withColumn("_bk", F.floor(F.col("_am") / g).cast("long"))
    bb = (b.withColumn("_bm", _micros(b, b_ts)).withColumn("_b0", F.floor(F.col("_bm") / g).cast("long"))
           .withColumn("_bk", F.explode(F.array(F.col("_b0"), F.col("_b0") - 1)))
           .drop("_b0"))
    lower = (F.col(b_ts) >= F.col(a_ts)) if lower_inclusive else (F.col(b_ts) > F.col(a_ts))
    cond = lower & (F.col("_bm") <= F.col("_am") + F.lit(g))
    return aa.join(bb, on=[key, "_bk"], how="inner").where(cond).drop("_bk", "_am", "_bm")


def carry_forward(df: DataFrame, by: Sequence[str], ts: str, cols: Sequence[str], *,
                  tiebreak: Sequence[str] = (), grain: str = "1 day",
                  inclusive: bool = True, suffix: str = "_ffill") -> DataFrame:
    """For every row, the latest non-null value of each of ``cols`` among rows
    of the same ``by`` group ordered at or before it (strictly before when
    ``inclusive`` is False). Adds ``<col><suffix>``.

    Two levels instead of one window per group: a window inside each
    (group, time bucket), plus the last value of every earlier bucket carried
    over a per-group table with one row per non-empty bucket. The work of a hot
    group is split by bucket; only the bucket summaries meet per group."""
    by, cols = list(by), list(cols)
    g = _grain_micros(grain)
    order = [F.col(ts)] + [F.col(c) for c in tiebreak]
    d = df.withColumn("_bk", F.floor(_micros(df, ts) / g).cast("long"))
    hi = 0 if inclusive else -1
    w_in = (Window.partitionBy(*by, "_bk").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, hi))
    for c in cols:
        d = d.withColumn(f"_in_{c}", F.last(c, ignorenulls=True).over(w_in))
    okey = F.struct(*order)
    summ = d.groupBy(*by, "_bk").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(f"_bl_{c}") for c in cols])
    w_prev = (Window.partitionBy(*by).orderBy("_bk")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = summ.select(*[F.col(k).alias(f"_ck{i}") for i, k in enumerate([*by, "_bk"])],
                        *[F.last(f"_bl_{c}", ignorenulls=True).over(w_prev).alias(f"_cy_{c}")
                          for c in cols])
    # null-safe on the keys, so rows with a null group key keep their carry
    cond = [F.col(k).eqNullSafe(F.col(f"_ck{i}")) for i, k in enumerate([*by, "_bk"])]
    out = d.join(carry, cond, how="left").drop(*[f"_ck{i}" for i in range(len(by) + 1)])
    for c in cols:
        out = out.withColumn(f"{c}{suffix}", F.coalesce(F.col(f"_in_{c}"), F.col(f"_cy_{c}")))
    return out.drop("_bk", *[f"_in_{c}" for c in cols], *[f"_cy_{c}" for c in cols])


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str,
              right_cols: Sequence[str], *, right_tiebreak: Sequence[str] = (),
              grain: str = "1 day", prefix: str = "") -> DataFrame:
    """For each ``left`` row, the latest ``right`` row of the same ``by`` key
    with ``right_ts <= left_ts`` (nulls when none). Every left row is kept
    exactly once. Built as union + ``carry_forward`` over a non-null struct of
    the right columns, so no key is processed whole in one task."""
    by, right_cols = list(by), list(right_cols)
    lcols = [c for c in left.columns]
    tb = list(right_tiebreak)
    payload = F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in right_cols])
    # as in SQL, null keys match nothing and a row without a time is never the latest
    known = right.where(F.col(right_ts).isNotNull())
    for c in by:
        known = known.where(F.col(c).isNotNull())
    r = known.select(*[F.col(c) for c in by], F.col(right_ts).alias("_t"),
                     F.lit(0).alias("_side"),
                     *[F.col(c).alias(f"_tb{i}") for i, c in enumerate(tb)],
                     payload.alias("_rv"))
    l = left.select(*[F.col(c) for c in by], F.col(left_ts).alias("_t"), F.lit(1).alias("_side"),
                    *[F.lit(None).cast(right.schema[c].dataType).alias(f"_tb{i}")
                      for i, c in enumerate(tb)],
                    F.lit(None).cast(r.schema["_rv"].dataType).alias("_rv"),
                    F.struct(*[F.col(c) for c in lcols]).alias("_lv"))
    r = r.withColumn("_lv", F.lit(None).cast(l.schema["_lv"].dataType))
    u = r.unionByName(l)
    # At equal times the right rows sort first, so "at or before" includes them.
    tbs = ["_side"] + [f"_tb{i}" for i in range(len(tb))]
    cf = carry_forward(u, by, "_t", ["_rv"], tiebreak=tbs, grain=grain, suffix="_m")
    out = cf.where(F.col("_side") == 1)
    return out.select(*[F.col("_lv")[c].alias(c) for c in lcols],
                      *[F.when(F.col("_t").isNotNull(), F.col("_rv_m")[f"{prefix}{c}"]).alias(f"{prefix}{c}") for c in right_cols])
