"""Streams over hand-made replays: late rows, state across batches, dedupe, upsert."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from support import SF_SMALL, rows
from tessera.session import scratch_path
from tessera.sources.tables import SCHEMAS
from tessera.streaming import late, operators as so
from tessera.streaming import sinks, snapshots, sources


def ts(day, h=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=h)


def replay(spark, data, order, name):
    """data: (chunk, event_id, ts, user_id, event_type, value)."""
    schema = T.StructType([T.StructField("chunk", T.IntegerType())] + SCHEMAS["events"].fields)
    df = spark.createDataFrame([(c, i, t, u, e, v, "{}") for c, i, t, u, e, v in data], schema)
    root = scratch_path(spark, name)
    for k in order:  # one file for each chunk; the stream takes the oldest first, one a micro-batch
        df.where(F.col("chunk") == k).drop("chunk").coalesce(1).write.parquet(f"{root}/chunk={k}")
    s = sources.file_stream(spark, root, T.StructType(SCHEMAS["events"].fields + [T.StructField("chunk", T.IntegerType())]),
                            max_files_per_trigger=1)
    return sources.with_event_time(s).drop("chunk")


def test_late_rows_stay_out_of_closed_windows(spark):
    # Spark filters late rows with the watermark of the previous batch, so the
    # late row comes two batches after the one that moved the watermark.
    data = [(0, 1, ts(0, 1), 1, "a", 1.0), (0, 2, ts(0, 2), 1, "a", 1.0),
            (1, 3, ts(3, 1), 1, "a", 1.0),
            (2, 6, ts(3, 3), 1, "a", 1.0),
            (3, 4, ts(0, 3), 1, "a", 1.0),   # day 0 again after the watermark passed it
            (3, 5, ts(3, 2), 1, "a", 1.0)]   # on time
    s = replay(spark, data, [0, 1, 2, 3], "t-late")
    log = sinks.run_changelog(so.tumbling(s, "ts", "1 day", ["event_type"], "1 hour"), "t-late-out")
    out = sinks.latest_by_key(log, ["window_start", "event_type"])
    got = rows(out.select(F.col("window_start").cast("timestamp_ntz").alias("w"), "n"))
    assert got == [(ts(0), 2), (ts(3), 3)]


def test_late_rows_come_out_beside_the_counts(spark):
    """The first batch after the one that moved the watermark already finds the window closed;
    a window's end itself is closed; nulls in keys and columns, ties and repeats stay as they are."""
    data = [(0, 1, ts(0, 1), 1, "a", 1.0), (0, 2, ts(0, 2), None, None, None),
            (1, 3, ts(2, 1), 1, "a", 1.0),                                             # watermark: day 2, 00:00
            (2, 4, ts(0, 3), 1, "a", float("nan")), (2, 4, ts(0, 3), 1, "a", 0.1), (2, 5, ts(1, 23), None, None, None),
            (2, 6, ts(2, 0), 1, "a", 1.0), (2, 7, None, 1, "a", 1.0),                  # on time; without a time
            (3, 2**60 + 1, ts(0, 0), 2**61 + 1, "b", None), (3, 8, ts(9), 1, "b", 1.0)]
    s = replay(spark, data, [0, 1, 2, 3], "t-split")
    log = sinks.run_changelog(late.split_late(s, "ts", "1 day", ["event_type"], "1 hour", salts=3), "t-split-out", conf=late.STATE_CONF)
    got = late.late_rows(log)
    assert got.columns == SCHEMAS["events"].fieldNames()
    out = sorted([(r.event_id, r.ts, r.user_id, r.event_type, repr(r.value)) for r in got.withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()], key=repr)
    assert out == sorted([(4, ts(0, 3), 1, "a", "nan"), (4, ts(0, 3), 1, "a", "0.1"), (5, ts(1, 23), None, None, "None"),
                          (2**60 + 1, ts(0, 0), 2**61 + 1, "b", "None")], key=repr)
    counts = late.window_counts(log, ["event_type"]).select(F.col("window_start").cast("timestamp_ntz").alias("w"), "event_type", "n", "n_late")
    assert rows(counts) == sorted([(ts(0), None, 1, 0), (ts(0), "a", 1, 2), (ts(0), "b", 0, 1), (ts(1), None, 0, 1), (ts(2), "a", 2, 0), (ts(9), "b", 1, 0)],
                                  key=lambda t: tuple((x is not None, x) for x in t))


def test_running_totals_keep_state_across_batches(spark):
    data = [(0, 1, ts(0), 1, "a", 1.5), (0, 2, ts(0, 1), 2, "a", 2.0),
            (1, 3, ts(1), 1, "b", 2.5), (2, 4, ts(2), 1, "c", 1.0)]
    s = replay(spark, data, [0, 1, 2], "t-totals")
    log = sinks.run_changelog(so.running_totals(s), "t-totals-out")
    assert rows(log, "user_id", "n_events", "total_value", "_batch") == [
        (1, 1, 1.5, 0), (1, 2, 4.0, 1), (1, 3, 5.0, 2), (2, 1, 2.0, 0)]
    assert rows(sinks.latest_by_key(log, ["user_id"]), "user_id", "n_events") == [(1, 3), (2, 1)]


def test_dedupe_within_watermark_across_batches(spark):
    data = [(0, 1, ts(0), 1, "a", 0.0), (1, 2, ts(0, 1), 1, "a", 0.0),   # repeat within 2 h: dropped
            (2, 10, ts(2), 2, "b", 0.0), (3, 11, ts(2, 1), 2, "c", 0.0),   # other keys move the watermark
            (4, 3, ts(2, 2), 1, "a", 0.0)]                                 # key seen again after expiry: kept
    s = replay(spark, data, [0, 1, 2, 3, 4], "t-dedupe")
    out = sinks.run_append(so.stream_dedupe(s, "ts", ["user_id", "event_type"], "2 hours"), "t-dedupe-out")
    assert rows(out, "event_id") == [(1,), (3,), (10,), (11,)]


def test_upsert_sink_keeps_newest_even_when_it_arrives_first(spark):
    data = [(0, 1, ts(5), 1, "new", 0.0), (1, 2, ts(1), 1, "old", 0.0), (1, 3, ts(2), 2, "x", 0.0)]
    s = replay(spark, data, [0, 1], "t-upsert").select("user_id", "event_id", "ts", "event_type")
    out = snapshots.upsert_sink(s, ["user_id"], ["ts", "event_id"], "t-upsert-out")
    assert rows(out, "user_id", "event_type") == [(1, "new"), (2, "x")]


def _table(spark, name, buckets=4):
    schema = T.StructType.fromDDL("k long, at int, v string")
    return snapshots.SnapshotTable(spark, scratch_path(spark, name), schema, ["k"], ["at", "v"], buckets), schema


def test_snapshots_replays_and_failed_attempts_change_nothing(spark):
    table, schema = _table(spark, "t-snap")
    make = lambda data: spark.createDataFrame(data, schema)
    assert table.read().collect() == [] and table.read().schema == schema and table.versions() == []
    table.merge(make([]), 0)
    assert table.versions() == []
    table.merge(make([(1, 1, "a"), (1, 3, "c"), (2, 1, None), (None, 1, "n"), (None, 0, "m")]), 1)
    first = rows(table.read())
    assert first == rows(make([(1, 3, "c"), (2, 1, None), (None, 1, "n")]))
    table.merge(make([(1, 9, "replayed with other rows")]), 1)
    assert rows(table.read()) == first
    publish, table._publish = table._publish, None
    try:  # the attempt dies before it publishes
        table.merge(make([(1, 8, "lost")]), 2)
    except TypeError:
        pass
    table._publish = publish
    assert rows(table.read()) == first and table.versions() == [1]
    table.merge(make([(1, 2, "old"), (3, 1, "new")]), 2)
    assert rows(table.read()) == rows(make([(1, 3, "c"), (2, 1, None), (3, 1, "new"), (None, 1, "n")]))
    assert rows(table.read(1)) == first


def test_snapshots_rewrite_touched_buckets_alone_and_expire(spark):
    table, schema = _table(spark, "t-snap-expire", buckets=8)
    make = lambda data: spark.createDataFrame(data, schema)
    table.merge(make([(k, 0, "x") for k in range(200)]), 0)
    before = table.manifest()
    assert len(before) == 8
    table.merge(make([(7, 1, "y")]), 1)
    after = table.manifest()
    assert sum(before[b] != after[b] for b in before) == 1
    files = table.read().where("k = 7").select("v").collect(), len(table.read().inputFiles())
    assert files == ([("y",)], 8)
    table.merge(make([(7, 2, "z"), (300, 0, "n")]), 2)
    assert table.expire(keep=2) >= 1 and table.versions() == [1, 2]  # staged rows, and the bucket that the first version alone named
    assert table.read(1).count() == 200 and table.read().count() == 201
    table.expire(keep=1)
    assert table.versions() == [2] and rows(table.read().where("at > 0")) == [(7, 2, "z")]
    named = {f.rsplit("/", 1)[0] for f in table.manifest().values()}
    assert {f"data/{n}" for n in table._list("data")} == named


def test_upsert_sink_of_an_empty_stream_and_a_second_run(spark):
    s = replay(spark, [], [0], "t-upsert-empty").select("user_id", "event_id", "ts", "event_type")
    out = snapshots.upsert_sink(s, ["user_id"], ["ts", "event_id"], "t-upsert-none")
    assert out.count() == 0 and out.schema == s.schema
    data = [(0, 1, ts(5), 1, "new", 0.0), (1, 2, ts(1), 1, "old", 0.0), (1, 3, ts(2), 2, "x", 0.0)]
    root = scratch_path(spark, "t-upsert-root")
    for _ in range(2):  # the second run finds nothing new
        s = replay(spark, data, [0, 1], "t-upsert-again").select("user_id", "event_id", "ts", "event_type") if not _ else s
        out = snapshots.upsert_sink(s, ["user_id"], ["ts", "event_id"], "again", root=root)
        assert rows(out, "user_id", "event_type") == [(1, "new"), (2, "x")]


def test_stream_interval_join_matches_batch(spark):
    data = [(0, 1, ts(0), 1, "view", 0.0), (0, 2, ts(0, 5), 1, "purchase", 0.0),
            (1, 3, ts(1), 1, "purchase", 0.0), (1, 4, ts(1, 1), 2, "view", 0.0),
            (1, 5, ts(1, 2), 2, "purchase", 0.0)]
    s1 = replay(spark, data, [0, 1], "t-join-a")
    s2 = replay(spark, data, [0, 1], "t-join-b")
    v = s1.where(F.col("event_type") == "view").select("user_id", F.col("event_id").alias("vid"),
                                                      F.col("ts").alias("vt"))
    p = s2.where(F.col("event_type") == "purchase").select("user_id", F.col("event_id").alias("pid"),
                                                          F.col("ts").alias("pt"))
    j = so.stream_interval_join(v, p, "user_id", "vt", "pt", "6 hours", "6 hours")
    out = sinks.run_append(j.select("vid", "pid"), "t-join-out")
    assert rows(out) == [(1, 2), (4, 5)]


def test_join_state_of_a_busy_user_lies_in_time_buckets(spark):
    """Results as of the batch form, with pairs at every edge of a bucket; state rows of one user in several partitions."""
    views = [(0, k, ts(0, 0) + dt.timedelta(minutes=37 * k), 1 if k % 2 else k, "view", 0.0) for k in range(120)]
    buys = [(0, 1000 + k, ts(0, 0) + dt.timedelta(minutes=37 * k + 360 * (k % 3) // 2), 1 if k % 2 else k, "purchase", 0.0) for k in range(120)]
    s = replay(spark, views + buys, [0], "t-busy")
    v = s.where("event_type = 'view'").select("user_id", F.col("event_id").alias("vid"), F.col("ts").alias("vt"))
    p = s.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("pid"), F.col("ts").alias("pt"))
    j = so.stream_interval_join(v, p, "user_id", "vt", "pt", "6 hours", "1 hour")
    assert "_bucket" not in j.columns
    out = rows(sinks.run_append(j.select("vid", "pid", F.spark_partition_id().alias("part"), F.col("a.user_id").alias("u")), "t-busy-out"))
    want = sorted((a[1], b[1]) for a in views for b in buys if a[3] == b[3] and a[2] <= b[2] <= a[2] + dt.timedelta(hours=6))
    assert [r[:2] for r in out] == want and len(want) > 100
    assert len({r[2] for r in out if r[3] == 1}) > 1  # a plain join on the user would keep all these in one partition


def test_sessions_of_a_busy_user_merge_before_the_shuffle(spark, tmp_path):
    """Rows that cross the shuffle: with merging, the open sessions of each task, not its events."""
    data = [(0, k, ts(0) + dt.timedelta(minutes=k), 1 if k % 3 else k, "x", 0.0) for k in range(600)]
    got, crossed = [], []
    for conf in (so.SESSION_CONF, {}):
        s = replay(spark, [*data, (1, 9999, ts(9), -1, "end", 0.0)], [0, 1], "t-sessions")
        with sinks._settings(spark, conf):
            q = (so.stream_sessions(s, "ts", "1 hour", ["user_id"], "1 hour").writeStream.format("memory").queryName("t_sessions").outputMode("append")
                 .option("checkpointLocation", scratch_path(spark, "t-sessions-ckpt")).trigger(availableNow=True).start())
            sinks._finish(q)
        got.append(rows(spark.table("t_sessions")))
        plan = q._jsq.explainInternal(False) if hasattr(q._jsq, "explainInternal") else q._jsq.toString()
        crossed.append(plan)
    assert got[0] == got[1] and (1, ts(0, 0) + dt.timedelta(minutes=1)) in [(r[0], r[1].replace(tzinfo=None)) for r in got[0]]
    assert crossed[0].count("MergingSessions") > crossed[1].count("MergingSessions")


def test_event_stream_reads_a_folder_of_files(spark, tmp_path):
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    n = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    for folder in (str(tmp_path), SF_SMALL):
        assert sinks.run_append(sources.event_stream(spark, folder), "folder").count() == n


def test_jobs_keep_rows_of_any_year_and_of_no_user(spark, tmp_path):
    from tessera.plans import QUERIES
    base = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    more = spark.createDataFrame([(900001, dt.datetime(2023, 5, 1), 1, "view", 1.0, "{}"), (900002, dt.datetime(2025, 5, 1), -1, "view", 1.0, "{}"),
                                  (900003, dt.datetime(2025, 6, 1), None, "view", None, "{}")], SCHEMAS["events"])
    base.unionByName(more).repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    n = base.count() + 3
    totals = QUERIES["stream_running_totals"](spark, str(tmp_path)).collect()
    assert sum(r["n_events"] for r in totals) == n
    assert [(r["n_events"], r["total_value"]) for r in totals if r["user_id"] is None] == [(1, None)]
    sessions = QUERIES["stream_sessions_24h"](spark, str(tmp_path)).collect()
    assert sum(r["n_events"] for r in sessions) == n and {-1, None} <= {r["user_id"] for r in sessions}
    assert QUERIES["stream_dedupe_events"](spark, str(tmp_path)).count() == n
    assert {-1, None} <= {r["user_id"] for r in QUERIES["stream_latest_per_user"](spark, str(tmp_path)).collect()}
