"""Stateful stream operators (P67-P71, P73; late rows are in ``late``).

Windows, sessions, dedupe and joins are bounded by a watermark, so the state
store drops what has closed; running totals keep one row per user.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import _grain_micros


def tumbling(stream: DataFrame, ts: str, size: str, by: Sequence[str], delay: str,
             value: str | None = None) -> DataFrame:
    """Counts (and sums of ``value``) per fixed window and key."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs.append(F.sum(value).alias(f"sum_{value}"))
    return (stream.withWatermark(ts, delay)
            .groupBy(F.window(ts, size).alias("w"), *by).agg(*aggs)
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *by, *[a for a in ["n"] + ([f"sum_{value}"] if value else [])]))


def sliding(stream: DataFrame, ts: str, size: str, step: str, by: Sequence[str],
            delay: str) -> DataFrame:
    """Counts per overlapping window (``size`` long, every ``step``) and key."""
    return (stream.withWatermark(ts, delay)
            .groupBy(F.window(ts, size, step).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *by, "n"))


#: Sessions of one task merge before the shuffle, so a busy key sends its open sessions, not its events.
SESSION_CONF = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def stream_sessions(stream: DataFrame, ts: str, gap: str, by: Sequence[str], delay: str) -> DataFrame:
    """Sessions per key (``session_window``): events closer than ``gap`` merge.
    Run it with ``SESSION_CONF``: each task merges the sessions of its own rows, and only
    these go to the key's task, a row for each session and task whatever the key's events."""
    return (stream.withWatermark(ts, delay)
            .groupBy(F.session_window(ts, gap).alias("s"), *by)
            .agg(F.count(F.lit(1)).alias("n_events"), F.max(ts).alias("session_last"))
            .select(*by, F.col("s.start").alias("session_start"), "session_last", "n_events"))


def stream_dedupe(stream: DataFrame, ts: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Drop rows whose key was already seen within the watermark delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_interval_join(a: DataFrame, b: DataFrame, key: str, a_ts: str, b_ts: str,
                         within: str, delay: str) -> DataFrame:
    """Stream-stream inner join: ``a_ts <= b_ts <= a_ts + within``, with the sides as ``a`` and ``b``.

    State is kept by (key, time bucket as wide as ``within``), as in the batch form: a row of
    ``a`` lies in its bucket, one of ``b`` in its own and the one before, so every pair
    meets in one bucket and a key with many rows is spread over its buckets. Watermarks
    on both sides plus the time bound let Spark expire the state of a bucket."""
    width = _grain_micros(within)

    def bucket(ts: str):
        return F.floor(F.unix_micros(F.col(ts)) / width).cast("long")

    aa = a.withWatermark(a_ts, delay).withColumn("_bucket", bucket(a_ts)).alias("a")
    bb = b.withWatermark(b_ts, delay).withColumn("_bucket", F.explode(F.array(bucket(b_ts), bucket(b_ts) - 1))).alias("b")
    cond = ((F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._bucket") == F.col("b._bucket"))
            & (F.col(f"b.{b_ts}") >= F.col(f"a.{a_ts}"))
            & (F.col(f"b.{b_ts}") <= F.col(f"a.{a_ts}") + F.expr(f"INTERVAL {within}")))
    return aa.join(bb, cond, "inner").drop("_bucket")


def running_totals(stream: DataFrame, user: str = "user_id", value: str = "value") -> DataFrame:
    """Per-user running event count and value total across micro-batches (run in
    update mode; the total of no values is null). A batch is reduced per user
    before the shuffle; the state is one row per user and stays, since a total
    over all time never closes."""
    return stream.groupBy(F.col(user).alias("user_id")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("total_value"))
