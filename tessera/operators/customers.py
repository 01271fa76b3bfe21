"""Customer and product analytics.

Per-user work is done on per-user-and-period aggregates (built with a partial
aggregate, so a heavy user is reduced map-side); windows then run over one
row per user and period, a size bounded by the time span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import _grain_micros, _micros, carry_forward
from tessera.operators.ordering import ntile_of, with_positions
from tessera.session import materialize, persist_table


def period_start(ts: str | Column, grain: str) -> Column:
    """Start date of the calendar period (day, week = ISO Monday, month, quarter, year)."""
    d = F.to_date(F.col(ts) if isinstance(ts, str) else ts)
    return d if grain == "day" else F.trunc(d, grain)


def periods_between(start: Column, end: Column, grain: str) -> Column:
    """Whole calendar periods from ``start`` to ``end`` (both period starts)."""
    if grain == "day":
        n = F.datediff(end, start)
    elif grain == "week":
        n = F.floor(F.datediff(end, start) / 7)
    elif grain == "month":
        n = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    elif grain == "quarter":
        n = (F.year(end) - F.year(start)) * 4 + F.quarter(end) - F.quarter(start)
    elif grain == "year":
        n = F.year(end) - F.year(start)
    else:
        raise ValueError(grain)
    return n.cast("long")


def _user_periods(df: DataFrame, user: str, ts: str, grain: str, amount: str | None = None):
    aggs = [F.count(F.lit(1)).alias("_rows")]
    if amount:
        aggs.append(F.sum(amount).alias("_amount"))
    up = df.groupBy(user, period_start(ts, grain).alias("period")).agg(*aggs)
    cohort = F.min("period").over(Window.partitionBy(user))
    return (up.withColumn("cohort", cohort)
              .withColumn("period_n", periods_between(F.col("cohort"), F.col("period"), grain)))


def cohort_retention(df: DataFrame, user: str, ts: str, grain: str = "month") -> DataFrame:
    """Active users per cohort (period of first activity) and period number,
    with cohort size and retention rate."""
    up = _user_periods(df, user, ts, grain)
    out = up.groupBy("cohort", "period_n").agg(F.count(F.lit(1)).alias("n_active"))
    size = F.max(F.when(F.col("period_n") == 0, F.col("n_active"))).over(Window.partitionBy("cohort"))
    return (out.withColumn("cohort_size", size)
               .withColumn("retention", F.col("n_active") / F.col("cohort_size")))


def day_n_retention(df: DataFrame, user: str, ts: str, max_day: int | None = None) -> DataFrame:
    """Users active exactly n days after their first active day, over all users."""
    up = _user_periods(df, user, ts, "day")
    if max_day is not None:
        up = up.where(F.col("period_n") <= max_day)
    out = up.groupBy(F.col("period_n").alias("day_n")).agg(F.count(F.lit(1)).alias("n_users"))
    total = F.max(F.when(F.col("day_n") == 0, F.col("n_users"))).over(Window.partitionBy())
    return out.withColumn("rate", F.col("n_users") / total)


def _chains(df: DataFrame, by: Sequence[str], at: str, is_step: Sequence[Column]) -> DataFrame:
    """Adds ``_c1`` ... ``_cK``: for a row that is step k, the times of step k and of the
    earliest later steps after it, as far as they come in the same ``by`` group.

    Windows over one exchange and one sort, time descending, so that every
    frame grows: what follows a row is what the frame has seen. Rows of equal
    times do not follow one another.
    """
    after = Window.partitionBy(*by).orderBy(F.col(at).desc()).rangeBetween(Window.unboundedPreceding, -1)
    for k in range(len(is_step), 0, -1):
        here = F.array(at)
        if k < len(is_step):
            rest = F.last(f"_c{k + 1}", ignorenulls=True).over(after)
            here = F.concat(here, F.coalesce(rest, F.array().cast("array<bigint>")))
        df = df.withColumn(f"_c{k}", F.when(is_step[k - 1], here))
    return df


def funnel_times(df: DataFrame, user: str, ts: str, step_col: str, steps: Sequence[str],
                 partitions: int | None = None) -> DataFrame:
    """For every user with a first step: ``times``, microseconds of the first step-1
    event, of the first step-2 event after it, and so on as far as the user got.

    One pass, without a join per step. Events are dealt to ranges of (user,
    time), so the events of one user lie in as many slices as they fill, each
    later than the one before. A slice is summed up by a table that composes:
    for each step the earliest time that it and the steps after it can end
    inside the slice if the steps before it ended earlier. Slices of a user,
    at most one for each range, are then put together in order of time: where
    one slice leaves off at step m, the next goes on with its chain of step m + 1.
    Rows without a user or a time take no part; a step may be named twice.
    """
    at = _micros(df, ts)
    events = df.where(F.col(user).isNotNull() & F.col(ts).isNotNull() & F.col(step_col).isin(list(steps)))
    events = events.select(F.col(user).alias("_u"), at.alias("_t"), F.col(step_col).alias("_s"))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = persist_table(events.repartitionByRange(n, "_u", "_t").withColumn("_slice", F.spark_partition_id()), "funnel-events")
    chains = _chains(dealt, ["_slice", "_u"], "_t", [F.col("_s") == s for s in steps])
    # chains of one step compare by their first time, and equal times have equal chains
    names = [f"_c{k}" for k in range(1, len(steps) + 1)]
    slices = chains.groupBy("_u", "_slice").agg(*[F.min(c).alias(c) for c in names])
    table = F.array(*[F.coalesce(F.col(c), F.array().cast("array<bigint>")) for c in names])
    whole = slices.groupBy("_u").agg(F.array_sort(F.collect_list(F.struct("_slice", table.alias("table")))).alias("slices"))
    nothing = F.array().cast("array<bigint>")
    times = F.aggregate("slices", nothing, lambda done, x: F.concat(done, F.coalesce(F.get(x["table"], F.size(done)), nothing)))
    return whole.select(F.col("_u").alias(user), times.alias("times")).where(F.size("times") > 0)


def funnel(df: DataFrame, user: str, ts: str, step_col: str, steps: Sequence[str],
           within: str, partitions: int | None = None) -> DataFrame:
    """Users reaching each step in order, every step after the previous one and
    within ``within`` of the user's first step-1 event (greedy: each step at its
    earliest qualifying time). Counts come from ``funnel_times``: earliest times
    ascend, so a user got as far as the last of them within the span. An empty
    input has every step with no users."""
    times = funnel_times(df, user, ts, step_col, steps, partitions)
    span = F.lit(_grain_micros(within))
    depth = times.select(F.size(F.filter("times", lambda t: t <= F.get("times", F.lit(0)) + span)).alias("depth"))
    counts = depth.agg(*[F.count(F.when(F.col("depth") >= k, 1)).alias(f"n{k}") for k in range(1, len(steps) + 1)])
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("step"), F.lit(s).alias("step_name"), F.col(f"n{k}").alias("n_users"))
                     for k, s in enumerate(steps, 1)])
    return counts.select(F.inline(rows))


def sessions(df: DataFrame, user: str, ts: str, gap: str, *, tiebreak: Sequence[str] = (),
             grain: str = "1 day", cut_lineage: bool = True) -> DataFrame:
    """Sessions per user: a new session starts when the time since the user's
    previous event is at least ``gap`` (the ``session_window`` rule). Returns
    one row per session: user, session_start, session_last, n_events,
    duration_s. The previous time and the session start are both carried with
    ``carry_forward``, so a heavy user is split by time bucket; the lineage is
    cut (reliable checkpoint) between the two passes."""
    gap_s = F.expr(f"INTERVAL {gap}")
    base = df.select(user, ts, *tiebreak)
    prev = carry_forward(base, [user], ts, [ts], tiebreak=tiebreak, grain=grain,
                         inclusive=False, suffix="_prev")
    starts = prev.withColumn(
        "_start", F.when(F.col(f"{ts}_prev").isNull() | (F.col(ts) >= F.col(f"{ts}_prev") + gap_s),
                         F.col(ts)))
    if cut_lineage:
        starts = materialize(starts)
    sess = carry_forward(starts.drop(f"{ts}_prev"), [user], ts, ["_start"], tiebreak=tiebreak,
                         grain=grain, suffix="_s")
    out = sess.groupBy(user, F.col("_start_s").alias("session_start")).agg(
        F.max(ts).alias("session_last"), F.count(F.lit(1)).alias("n_events"))
    return out.withColumn("duration_s", F.timestamp_diff("SECOND", F.col("session_start"),
                                                         F.col("session_last")))


def active_users(df: DataFrame, user: str, ts: str,
                 grains: Sequence[str] = ("day", "week", "month")) -> DataFrame:
    """Distinct active users per calendar period for each grain (DAU/WAU/MAU):
    rows (grain, period_start, active_users). Users are first reduced to
    distinct (user, day) pairs."""
    ud = df.select(user, F.to_date(ts).alias("_d")).distinct()
    parts = []
    for g in grains:
        p = ud.select(user, period_start("_d", g).alias("period_start")).distinct()
        parts.append(p.groupBy("period_start").agg(F.count(F.lit(1)).alias("active_users"))
                     .select(F.lit(g).alias("grain"), "period_start", "active_users"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stickiness(df: DataFrame, user: str, ts: str) -> DataFrame:
    """Per month: mean daily active users, monthly active users, and their ratio."""
    ud = df.select(user, F.to_date(ts).alias("_d")).distinct()
    dau = (ud.groupBy("_d").agg(F.count(F.lit(1)).alias("_dau"))
             .groupBy(F.trunc("_d", "month").alias("month")).agg(F.avg("_dau").alias("avg_dau")))
    mau = (ud.select(user, F.trunc("_d", "month").alias("month")).distinct()
             .groupBy("month").agg(F.count(F.lit(1)).alias("mau")))
    return dau.join(mau, "month").withColumn("stickiness", F.col("avg_dau") / F.col("mau"))


def ltv(df: DataFrame, user: str, ts: str, amount: str, grain: str = "quarter") -> DataFrame:
    """Cumulative revenue per cohort member by period number."""
    up = _user_periods(df, user, ts, grain, amount)
    out = up.groupBy("cohort", "period_n").agg(F.sum("_amount").alias("revenue"),
                                                 F.count(F.lit(1)).alias("n_active"))
    wc = Window.partitionBy("cohort")
    size = F.max(F.when(F.col("period_n") == 0, F.col("n_active"))).over(wc)
    cum = F.sum("revenue").over(wc.orderBy("period_n").rowsBetween(Window.unboundedPreceding, 0))
    return (out.withColumn("cohort_size", size).withColumn("cum_revenue", cum)
               .withColumn("ltv", F.col("cum_revenue") / F.col("cohort_size")))


def rfm(df: DataFrame, user: str, ts: str, amount: str, as_of: str, k: int = 5,
        cut_lineage: bool = True) -> DataFrame:
    """Recency (days from last activity to ``as_of``), frequency, money, and
    their 1..k scores (higher is better) by ntile over all users, ties broken by
    user key. The ntiles come from range positions, not a one-task window.
    Give ``amount`` as a decimal for exact money sums. The per-user table is
    materialized once (reliable checkpoint) and the
    three scores are computed from it independently and joined on the user."""
    per = df.groupBy(user).agg(
        F.datediff(F.lit(as_of).cast("date"), F.to_date(F.max(ts))).cast("long").alias("recency_days"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum(amount).cast("double").alias("monetary"))
    if cut_lineage:
        per = materialize(per)
    specs = [("r_score", "-recency_days"), ("f_score", "frequency"), ("m_score", "monetary")]
    out = per
    for name, o in specs:
        p = with_positions(per.select(user, o.lstrip("-")), [o, user])
        score = p.select(user, ntile_of(F.col("_pos"), F.col("_n"), k).alias(name))
        out = out.join(score, user)
    return out


def abc(df: DataFrame, item: str, amount: str, a: float = 0.8, b: float = 0.95) -> DataFrame:
    """ABC classes by cumulative share of the total: items sorted by amount
    (descending, then key); class A while the inclusive cumulative share is at
    most ``a``, B up to ``b``, else C. Running sums come from range-partitioned
    positions with per-partition offsets, not a one-task window. With a
    decimal ``amount`` the running sums are exact, so the class boundaries do
    not depend on summation order."""
    per = df.groupBy(item).agg(F.sum(amount).alias("amount"))
    p = with_positions(per, ["-amount", item], running="amount")
    share = F.try_divide(F.col("_cum").cast("double"), F.col("_tot").cast("double"))  # null (class C) if the total is 0
    return (p.withColumn("cum_share", share)
             .withColumn("class", F.when(F.col("cum_share") <= a, "A")
                         .when(F.col("cum_share") <= b, "B").otherwise("C"))
             .withColumnRenamed("_pos", "rank")
             .drop("_n", "_cum", "_tot"))


def first_last_touch(df: DataFrame, user: str, ts: str, value: str,
                     tiebreak: Sequence[str] = ()) -> DataFrame:
    """First and last ``value`` per user in time order (``min_by`` / ``max_by``
    on a total order key; partial aggregates, so skew-safe)."""
    key = F.struct(F.col(ts), *[F.col(c) for c in tiebreak])
    return df.groupBy(user).agg(
        F.min_by(value, key).alias(f"first_{value}"), F.max_by(value, key).alias(f"last_{value}"),
        F.min(ts).alias(f"first_{ts}"), F.max(ts).alias(f"last_{ts}"))
