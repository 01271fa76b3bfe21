"""Jobs: Structured Streaming forms of the event operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import scratch_path
from tessera.sources.tables import SCHEMAS
from tessera.streaming import late, operators as so
from tessera.streaming import sinks, snapshots, sources
from tessera.plans.registry import register, tables


def _ntz(c):
    return F.col(c).cast("timestamp_ntz").alias(c)


@register("events_stream_passthrough", sql="""
SELECT event_id, ts, user_id, event_type, value, props FROM events
""")
def events_stream_passthrough(spark, sf_dir):
    """P05 event_stream: the events table through a stream and a parquet sink."""
    tables(spark, sf_dir)
    s = sources.event_stream(spark, sf_dir)
    out = sinks.run_append(s, "passthrough")
    return out.select("event_id", _ntz("ts"), "user_id", "event_type", "value", "props")


@register("stream_tumbling_daily", sql="""
SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2
""")
def stream_tumbling_daily(spark, sf_dir):
    """P67 tumbling: daily counts per type, update mode, final values."""
    tables(spark, sf_dir)
    s = sources.event_stream(spark, sf_dir)
    log = sinks.run_changelog(so.tumbling(s, "ts", "1 day", ["event_type"], "1 hour"), "tumbling")
    out = sinks.latest_by_key(log, ["window_start", "event_type"])
    return out.select(_ntz("window_start"), "event_type", "n")


@register("stream_sliding_daily_6h", sql="""
WITH b AS (SELECT event_type, epoch_us(ts) AS us FROM events),
     w AS (SELECT event_type, (us // 21600000000) * 21600000000 - k * 21600000000 AS start_us
           FROM b, range(0, 4) r(k))
SELECT make_timestamp(start_us) AS window_start, make_timestamp(start_us + 86400000000) AS window_end,
       event_type, count(*) AS n
FROM w GROUP BY 1, 2, 3
""")
def stream_sliding_daily_6h(spark, sf_dir):
    """P68 sliding: 1-day windows every 6 hours per type."""
    tables(spark, sf_dir)
    s = sources.event_stream(spark, sf_dir)
    log = sinks.run_changelog(so.sliding(s, "ts", "1 day", "6 hours", ["event_type"], "1 hour"),
                              "sliding")
    out = sinks.latest_by_key(log, ["window_start", "event_type"])
    return out.select(_ntz("window_start"), _ntz("window_end"), "event_type", "n")


@register("stream_sessions_24h", sql="""
WITH x AS (SELECT user_id, ts, event_id,
                  lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
     y AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 24 HOUR THEN 1 ELSE 0 END)
                     OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid
           FROM x)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_last, count(*) AS n_events
FROM y GROUP BY user_id, sid
""")
def stream_sessions_24h(spark, sf_dir):
    """P69 stream_sessions: session windows with a 24 h gap in append mode; the
    bounded replay ends with a marker event so the last sessions close."""
    t = tables(spark, sf_dir)
    marker = {"event_id": -1, "user_id": -1, "event_type": "__end__", "value": 0.0, "props": ""}
    root = sources.write_with_end_marker(t.events, "ts", "2 days", marker, "sessions-input")
    schema = T.StructType(SCHEMAS["events"].fields + [T.StructField("part", T.StringType())])
    s = sources.with_event_time(sources.file_stream(spark, root, schema)).drop("part")
    out = sinks.run_append(so.stream_sessions(s, "ts", "24 hours", ["user_id"], "1 hour"), "sessions", so.SESSION_CONF)
    # the marker's own session lies past the watermark and is never emitted
    return out.select("user_id", _ntz("session_start"), _ntz("session_last"), "n_events")


@register("stream_dedupe_events", sql="SELECT event_id, ts, user_id, event_type FROM events")
def stream_dedupe_events(spark, sf_dir):
    """P70 stream_dedupe: a stream that delivers every event twice, as a source
    with retries may, gives each event once."""
    tables(spark, sf_dir)
    s = sources.event_stream(spark, sf_dir)
    twice = s.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    out = sinks.run_append(so.stream_dedupe(twice, "ts", ["event_id"], "1 hour"), "dedupe")
    return out.select("event_id", _ntz("ts"), "user_id", "event_type")


@register("stream_view_purchase_6h", sql="""
SELECT v.user_id, v.event_id AS view_id, p.event_id AS purchase_id,
       (epoch_us(p.ts) - epoch_us(v.ts)) / 1000000.0 AS lag_s
FROM events v JOIN events p
  ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase'
 AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 6 HOUR
""")
def stream_view_purchase_6h(spark, sf_dir):
    """P71 stream_interval_join: the batch P24 as a stream-stream join."""
    tables(spark, sf_dir)
    s = sources.event_stream(spark, sf_dir)
    v = s.where(F.col("event_type") == "view").select("user_id", F.col("event_id").alias("view_id"),
                                                     F.col("ts").alias("view_ts"))
    p = sources.event_stream(spark, sf_dir).where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("p_user_id"), F.col("event_id").alias("purchase_id"),
        F.col("ts").alias("purchase_ts"))
    p = p.withColumnRenamed("p_user_id", "user_id")
    j = so.stream_interval_join(v, p, "user_id", "view_ts", "purchase_ts", "6 hours", "6 hours")
    lag = (F.unix_micros(F.col("purchase_ts")) - F.unix_micros(F.col("view_ts"))) / 1_000_000.0
    j = j.select(F.col("a.user_id").alias("user_id"), "view_id", "purchase_id", lag.alias("lag_s"))
    return sinks.run_append(j, "interval_join")


def _late_deliveries(spark, sf_dir, name, run):
    """Events in three deliveries: the second sixth of the table's days comes last
    and after the last sixth, each delivery a folder of part files and a run of the
    stream that goes on from the checkpoint of the one before. ``run(stream, root)``
    gives the changelog."""
    events = tables(spark, sf_dir).events
    day = F.to_date("ts")
    lo, hi = events.select(F.min(day)).scalar(), events.select(F.max(day)).scalar()
    sixth = F.floor(F.datediff(day, lo) * 6 / (F.datediff(hi, lo) + 1))
    delivery = F.when(sixth == 1, 2).when(sixth == 5, 1).otherwise(0)
    folder, root = scratch_path(spark, f"{name}-input"), scratch_path(spark, name)
    schema = T.StructType(SCHEMAS["events"].fields + [T.StructField("delivery", T.IntegerType())])
    for k in range(3):
        events.where(delivery == k).write.parquet(f"{folder}/delivery={k}")
        log = run(sources.with_event_time(sources.file_stream(spark, folder, schema)).drop("delivery"), root)
    return log


_SIXTH = "date_diff('day', lo, CAST(ts AS DATE)) * 6 // (date_diff('day', lo, hi) + 1)"


@register("stream_late_rows", sql=f"""
WITH span AS (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM events)
SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events, span
WHERE {_SIXTH} <> 1
GROUP BY 1, 2
""")
def stream_late_rows(spark, sf_dir):
    """P72 in Spark's own way: daily counts with a 1-day watermark while the second sixth
    of the table's days arrives last; those windows were closed, so their rows
    are left out."""
    log = _late_deliveries(spark, sf_dir, "late", lambda s, root: sinks.run_changelog(
        so.tumbling(s, "ts", "1 day", ["event_type"], "1 day"), "late", root=root))
    out = sinks.latest_by_key(log, ["window_start", "event_type"])
    return out.select(_ntz("window_start"), "event_type", "n")


def _split(stream, root):
    return sinks.run_changelog(late.split_late(stream, "ts", "1 day", ["event_type"], "1 day"), "late-split", root=root, conf=late.STATE_CONF)


@register("stream_late_side_rows", sql=f"""
WITH span AS (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM events)
SELECT event_id, ts, user_id, event_type, value, props FROM events, span WHERE {_SIXTH} = 1
""")
def stream_late_side_rows(spark, sf_dir):
    """P72 late_rows: the rows that came after their day was closed, whole."""
    out = late.late_rows(_late_deliveries(spark, sf_dir, "late-rows", _split))
    return out.select("event_id", _ntz("ts"), "user_id", "event_type", "value", "props")


@register("stream_late_counts", sql=f"""
WITH span AS (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM events)
SELECT date_trunc('day', ts) AS window_start, event_type, CAST(count(*) FILTER (WHERE {_SIXTH} <> 1) AS BIGINT) AS n,
       CAST(count(*) FILTER (WHERE {_SIXTH} = 1) AS BIGINT) AS n_late
FROM events, span GROUP BY 1, 2
""")
def stream_late_counts(spark, sf_dir):
    """P72 window_counts: rows that counted and rows that came too late, by day and type."""
    out = late.window_counts(_late_deliveries(spark, sf_dir, "late-counts", _split), ["event_type"])
    return out.select(_ntz("window_start"), "event_type", "n", "n_late")


@register("stream_running_totals", sql="""
SELECT user_id, count(*) AS n_events, round(sum(value), 2) AS total_value FROM events GROUP BY 1
""")
def stream_running_totals(spark, sf_dir):
    """P73 running_totals: per-user count and total of the event stream."""
    tables(spark, sf_dir)
    s = sources.event_stream(spark, sf_dir)
    log = sinks.run_changelog(so.running_totals(s), "totals")
    out = sinks.latest_by_key(log, ["user_id"])
    return out.select("user_id", "n_events", F.round("total_value", 2).alias("total_value"))


@register("stream_latest_per_user", sql="""
SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1
""")
def stream_latest_per_user(spark, sf_dir):
    """P74 upsert_sink: latest event per user kept up to date across batches."""
    tables(spark, sf_dir)
    s = sources.event_stream(spark, sf_dir).select("user_id", "event_id", "ts", "event_type", "value")
    out = snapshots.upsert_sink(s, ["user_id"], ["ts", "event_id"], "upsert", buckets=16)
    return out.select("user_id", "event_id", _ntz("ts"), "event_type", "value")
