"""Hand-made tables for what the fixtures cannot show: nulls, ties, a hot
key, empty input, rows on bucket edges."""

import datetime as dt
import decimal
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from support import rows
from tessera.operators import aggregates as agg
from tessera.operators import cleaning as cl
from tessera.operators import customers as cu
from tessera.operators import joins, ordering, sketches


def ts(day, h=0, m=0, s=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=h, minutes=m, seconds=s)


# ---------------------------------------------------------------- ordering

@pytest.fixture(scope="module")
def skewed(spark):
    """A hot group holding about a third of the rows, many ties."""
    rnd = random.Random(3)
    data = [(i, "hot" if i % 3 == 0 else f"g{i % 7}", float(rnd.randint(0, 20))) for i in range(600)]
    return spark.createDataFrame(data, "id long, g string, v double"), data


def test_positions_global_and_grouped(spark, skewed):
    df, data = skewed
    p = ordering.with_positions(df, ["v", "id"], partitions=5)
    got = rows(p, "id", "_pos", "_n")
    exp = sorted((r[0], k + 1, len(data)) for k, r in enumerate(sorted(data, key=lambda r: (r[2], r[0]))))
    assert got == sorted(exp)
    pg = ordering.with_positions(df, ["-v", "id"], by=["g"], running="v", partitions=5)
    by_g = {}
    for r in sorted(data, key=lambda r: (-r[2], r[0])):
        by_g.setdefault(r[1], []).append(r)
    exp = []
    for g, rs in by_g.items():
        cum = 0.0
        for k, r in enumerate(rs):
            cum += r[2]
            exp.append((r[0], k + 1, len(rs), cum, sum(x[2] for x in rs)))
    assert rows(pg, "id", "_pos", "_n", "_cum", "_tot") == sorted(exp)


def test_ntile_matches_sql(spark, skewed):
    df, _ = skewed
    df.createOrReplaceTempView("sk")
    exp = rows(spark.sql("SELECT id, ntile(7) OVER (PARTITION BY g ORDER BY v, id) AS t FROM sk"))
    got = rows(ordering.ntile(df, 7, ["v", "id"], by=["g"], name="t", partitions=5), "id", "t")
    assert got == exp


def test_rank_all_with_ties_and_nulls(spark):
    data = [(1, "a", 5.0), (2, "a", 5.0), (3, "a", None), (4, "a", 7.0), (5, "b", 1.0), (6, "a", 2.0)]
    df = spark.createDataFrame(data, "id long, g string, v double")
    df.createOrReplaceTempView("rk")
    exp = rows(spark.sql("""SELECT id, rank() OVER w, dense_rank() OVER w, percent_rank() OVER w,
                            cume_dist() OVER w FROM rk WINDOW w AS (PARTITION BY g ORDER BY v)"""))
    got = rows(ordering.rank_all(df, ["g"], "v", ["id"], partitions=3), "id", "rnk", "drnk", "prank", "cdist")
    assert got == exp


def test_exact_quantiles_match_numpy(spark, skewed):
    df, data = skewed
    q = ordering.exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.9, 1.0], by=["g"],
                                 names=["a", "b", "c", "d", "e"], partitions=5)
    got = {r["g"]: [r[c] for c in "abcde"] for r in q.collect()}
    for g in got:
        vals = [r[2] for r in data if r[1] == g]
        exp = np.percentile(vals, [0, 10, 50, 90, 100])
        assert np.allclose(got[g], exp)


def test_exact_quantiles_ignore_nulls_and_single_row(spark):
    df = spark.createDataFrame([("x", None), ("x", 4.0), ("y", 1.0), ("y", 3.0)], "g string, v double")
    q = {r["g"]: r["q50"] for r in ordering.exact_quantiles(df, "v", [0.5], by=["g"]).collect()}
    assert q == {"x": 4.0, "y": 2.0}


# ------------------------------------------------------------------- joins

def test_carry_forward_crosses_buckets_and_skips_nulls(spark):
    data = [(1, 1, ts(0, 1), 10.0), (2, 1, ts(0, 5), None), (3, 1, ts(3, 2), None),
            (4, 1, ts(3, 2), 7.0), (5, 2, ts(1), None), (6, 1, ts(9), None)]
    df = spark.createDataFrame(data, "id long, u long, t timestamp_ntz, v double")
    out = joins.carry_forward(df, ["u"], "t", ["v"], tiebreak=["id"], grain="1 day")
    assert rows(out, "id", "v_ffill") == [(1, 10.0), (2, 10.0), (3, 10.0), (4, 7.0), (5, None), (6, 7.0)]
    ex = joins.carry_forward(df, ["u"], "t", ["v"], tiebreak=["id"], grain="1 day", inclusive=False)
    assert rows(ex, "id", "v_ffill") == [(1, None), (2, 10.0), (3, 10.0), (4, 10.0), (5, None), (6, 7.0)]


def test_asof_join_ties_and_no_match(spark):
    left = spark.createDataFrame([(1, 1, ts(0, 5)), (2, 1, ts(2)), (3, 2, ts(0)), (4, 1, ts(0, 1))],
                                 "lid long, u long, lt timestamp_ntz")
    right = spark.createDataFrame([(10, 1, ts(0, 5)), (11, 1, ts(0, 4)), (12, 2, ts(0, 1)), (13, 1, ts(1, 23))],
                                  "rid long, u long, rt timestamp_ntz")
    out = joins.asof_join(left, right, ["u"], "lt", "rt", ["rid"], right_tiebreak=["rid"], grain="1 day")
    # equal time counts as "at or before"; a key without earlier rows gets null
    assert rows(out, "lid", "rid") == [(1, 10), (2, 13), (3, None), (4, None)]


def test_interval_join_on_bucket_edges(spark):
    a = spark.createDataFrame([(1, 1, ts(0, 5, 59, 59)), (2, 1, ts(0, 0)), (3, 2, ts(0))],
                              "aid long, u long, at timestamp_ntz")
    b = spark.createDataFrame([(10, 1, ts(0, 6)), (11, 1, ts(0, 11, 59, 59)), (12, 1, ts(0, 12, 0, 0)),
                               (13, 2, ts(0, 6, 0, 1))], "bid long, u long, bt timestamp_ntz")
    out = joins.interval_join(a, b, "u", "at", "bt", "6 hours")
    exp = sorted((x, y) for x, at in [(1, ts(0, 5, 59, 59)), (2, ts(0))]
                 for y, bt in [(10, ts(0, 6)), (11, ts(0, 11, 59, 59)), (12, ts(0, 12))]
                 if at <= bt <= at + dt.timedelta(hours=6))
    assert rows(out, "aid", "bid") == exp


def test_reconcile_null_safe(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1.0), (3, "z", 2.0)], "k long, s string, p double")
    b = spark.createDataFrame([(1, "x", None), (2, "y", 1.5), (4, "w", 0.0)], "k long, s string, p double")
    out = joins.reconcile(a, b, ["k"], ["s", "p"])
    assert rows(out, "k", "status") == [(2, "changed"), (3, "only_a"), (4, "only_b")]


def test_tier_join_keeps_unmatched(spark):
    df = spark.createDataFrame([(1, -5.0), (2, 5.0), (3, 50.0), (4, None)], "id long, x double")
    tiers = spark.createDataFrame([("lo", 0.0, 10.0), ("hi", 10.0, 20.0)], "tier string, lo double, hi double")
    assert rows(joins.tier_join(df, "x", tiers), "id", "tier") == [(1, None), (2, "lo"), (3, None), (4, None)]


# --------------------------------------------------------------- customers

def test_sessions_gap_boundary(spark):
    data = [(1, 1, ts(0)), (2, 1, ts(0, 23, 59, 59)), (3, 1, ts(1, 23, 59, 59)), (4, 1, ts(5)), (5, 2, ts(0))]
    df = spark.createDataFrame(data, "id long, u long, t timestamp_ntz")
    out = cu.sessions(df, "u", "t", "24 hours", tiebreak=["id"], grain="1 hour")
    # exactly 24 h after the previous event starts a new session (session_window rule)
    assert rows(out, "u", "session_start", "n_events") == [
        (1, ts(0), 2), (1, ts(1, 23, 59, 59), 1), (1, ts(5), 1), (2, ts(0), 1)]


def test_funnel_requires_order_and_span(spark):
    data = [(1, ts(0), "a"), (1, ts(0, 1), "b"), (1, ts(0, 2), "c"),
            (2, ts(0, 1), "b"), (2, ts(0, 2), "a"), (2, ts(0, 3), "c"),
            (3, ts(0), "a"), (3, ts(3), "b")]
    df = spark.createDataFrame(data, "u long, t timestamp_ntz, e string")
    out = cu.funnel(df, "u", "t", "e", ["a", "b", "c"], "48 hours")
    assert rows(out, "step", "n_users") == [(1, 3), (2, 1), (3, 1)]


def test_funnel_empty_input(spark):
    df = spark.createDataFrame([], "u long, t timestamp_ntz, e string")
    assert rows(cu.funnel(df, "u", "t", "e", ["a", "b"], "1 hour"), "step", "n_users") == [(1, 0), (2, 0)]


def _funnel_counts(events, steps, hours):
    """events: (user, hour, step)."""
    counts = [0] * len(steps)
    for u in {e[0] for e in events if e[0] is not None}:
        mine = [(h, e) for v, h, e in events if v == u and h is not None]
        at = first = min((h for h, e in mine if e == steps[0]), default=None)
        for k, s in enumerate(steps):
            if k and at is not None:
                at = min((h for h, e in mine if e == s and at < h <= first + hours), default=None)
            counts[k] += at is not None
    return [(k, n) for k, n in enumerate(counts, 1)]


@pytest.mark.parametrize("steps", [["a"], ["a", "b", "c", "d"], ["a", "a", "b"], ["b", "a", "b", "a"]])
def test_funnel_slices_a_hot_user(spark, monkeypatch, steps):
    """Ties, nulls and a user with half the events, whose slices lie in several ranges."""
    rnd = random.Random(len(steps))
    events = [(rnd.choice([1, 1, 1, 2, 3, 4, None]), rnd.choice([*range(60), None]), rnd.choice("abcdx")) for _ in range(500)]
    df = spark.createDataFrame([(u, None if h is None else ts(0, h) if h < 24 else ts(h // 24, h % 24), e) for u, h, e in events],
                               "u long, t timestamp_ntz, e string")
    dealt = []
    monkeypatch.setattr(cu, "persist_table", lambda d, name: dealt.append(d.checkpoint()) or dealt[-1])
    for hours in (5, 40):
        out = cu.funnel(df, "u", "t", "e", steps, f"{hours} hours", partitions=6)
        assert rows(out, "step", "n_users") == _funnel_counts(events, steps, hours)
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert dealt[0].where("_u = 1").select("_slice").distinct().count() >= 3


def test_abc_classes(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([50, 30, 10, 5, 5])], "item long, amt double")
    out = cu.abc(df, "item", "amt")
    # cumulative shares 0.5, 0.8, 0.9, 0.95, 1.0; A up to 0.8, B up to 0.95
    assert rows(out, "item", "class") == [(0, "A"), (1, "A"), (2, "B"), (3, "B"), (4, "C")]


def test_first_last_touch_tie_break(spark):
    df = spark.createDataFrame([(1, ts(0), 2, "x"), (1, ts(0), 1, "y"), (1, ts(1), 3, "z")],
                               "u long, t timestamp_ntz, id long, v string")
    r = cu.first_last_touch(df, "u", "t", "v", tiebreak=["id"]).first()
    assert (r["first_v"], r["last_v"]) == ("y", "z")


# ---------------------------------------------------------------- cleaning

def test_dedupe_latest_hot_key(spark):
    data = [(1 if i % 2 else i, i, float(i)) for i in range(200)]
    df = spark.createDataFrame(data, "k long, t long, v double")
    out = cl.dedupe_latest(df, ["k"], ["t"])
    exp = {}
    for k, t, v in data:
        if k not in exp or t > exp[k][0]:
            exp[k] = (t, v)
    assert rows(out, "k", "t", "v") == sorted((k, t, v) for k, (t, v) in exp.items())


def test_impute_median_and_all_null_group(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "a", 3.0), (4, "b", None)],
                               "id long, g string, x double")
    out = cl.impute(df, "x", ["g"], "median")
    assert rows(out, "id", "x_filled") == [(1, 1.0), (2, 2.0), (3, 3.0), (4, None)]
    mean = cl.impute(df, "x", ["g"], "mean")
    assert rows(mean, "id", "x_filled")[1] == (2, 2.0)


def test_profile_counts_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 2.0), (2, 4.0)], "a long, b double")
    got = {r["column_name"]: r for r in cl.profile(df, ["a", "b"]).collect()}
    assert (got["b"]["n_nulls"], got["b"]["n_distinct"], got["b"]["mean"]) == (1, 2, 3.0)
    assert (got["a"]["n_rows"], got["a"]["n_distinct"], got["a"]["max_value"]) == (3, 2, 2.0)


def test_profile_by_type(spark):
    schema = "n int, d decimal(5,2), s string, day date, at timestamp_ntz, ok boolean, xs array<int>"
    data = [(1, decimal.Decimal("1.50"), "b", dt.date(2024, 1, 2), ts(1), True, [1]), (1, None, "é", dt.date(2023, 1, 2), ts(0), False, None), (None, None, None, None, None, None, [1])]
    df = spark.createDataFrame(data, schema)
    for exact in (True, False):
        got = {r.column_name: r for r in cl.profile(df, exact_distinct=exact).collect()}
        assert list(got) == df.columns and [got[c].kind for c in got] == ["number", "number", "text", "time", "time", "flag", "other"]
        assert [(got[c].n_rows, got[c].n_nulls, got[c].n_distinct) for c in got] == [(3, 1, 1), (3, 2, 1), (3, 1, 2), (3, 1, 2), (3, 1, 2), (3, 1, 2), (3, 1, 1)]
    assert (got["n"].mean, got["n"].median, got["n"].top_value, got["n"].top_count) == (1.0, 1.0, "1", 2)
    assert (got["s"].min_text, got["s"].max_text, got["s"].min_length, got["s"].max_length, got["s"].mean) == ("b", "é", 1, 1, None)
    assert (got["day"].min_text, got["day"].max_text, got["at"].max_text) == ("2023-01-02", "2024-01-02", "2024-01-02 00:00:00")
    assert got["ok"].mean == 0.5 and got["xs"].top_value is None
    none = cl.profile(df.where("false")).collect()
    assert len(none) == 7 and all((r.n_rows, r.n_nulls, r.n_distinct, r.mean, r.top_count) == (0, 0, 0, None, None) for r in none)


def test_safe_cast_and_failures(spark):
    df = spark.createDataFrame([(1, "1"), (2, "x"), (3, None), (4, "2.5")], "id long, s string")
    assert rows(cl.safe_cast(df, {"s": "int"})) == [(1, 1), (2, None), (3, None), (4, None)]
    f = cl.cast_failures(df, {"s": "int"}).first()
    assert f["n_failed"] == 2


def test_bin_edges(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (9.999,), (10.0,), (100.0,), (None,)], "x double")
    out = rows(cl.bin_counts(df, "x", 0.0, 100.0, 10), "bucket", "n")
    assert out == [(0, 1), (1, 2), (2, 1), (11, 1)]


def test_iqr_outliers_global(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 100])],
                               "id long, v double")
    assert rows(cl.iqr_outliers(df, "v"), "id") == [(8,)]


# -------------------------------------------------------------- aggregates

def test_pivot_counts_zero_for_missing(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "k string, c string")
    assert rows(agg.pivot_counts(df, ["k"], "c", ["x", "y", "z"])) == [("a", 2, 0, 0), ("b", 0, 1, 0)]


def test_set_ops_multiset(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x long")
    b = spark.createDataFrame([(1,), (3,)], "x long")
    assert rows(agg.common(a, b, all=True)) == [(1,)]
    assert rows(agg.difference(a, b, all=True)) == [(1,), (2,)]
    assert rows(agg.difference(a, b)) == [(2,)]


def test_top_n_per_group_is_window_group_limit(spark, skewed):
    df, _ = skewed
    out = agg.top_n_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert out.count() == 2 * 8


def test_approx_distinct_within_error(spark):
    df = spark.range(0, 20000).withColumn("g", F.lit(1))
    r = agg.distinct_counts_approx(df, ["g"], ["id"], rsd=0.02).first()
    assert abs(r["approx_id"] - 20000) / 20000 < 0.06
    assert abs(r["hll_id"] - 20000) / 20000 < 0.06


def test_stored_sketches_merge_without_the_events(spark):
    """Merged sketches estimate as one sketch of all rows does; the plan reads the stored table alone."""
    df = spark.range(40_000).select((F.col("id") % 30).alias("day"), (F.col("id") * 7919 % 9000).alias("u"), F.lit(None).cast("string").alias("none"))
    daily = sketches.count_sketches(df, ["day"], ["u", "none"], store="t-sketches")
    assert daily.count() == 30
    merged = sketches.sketched_counts(sketches.merge_sketches(daily, [(F.col("day") % 3).alias("third")]))
    assert all("t-sketches" in f for f in merged.inputFiles())
    exact = df.groupBy((F.col("day") % 3).alias("third")).agg(F.count_distinct("u").alias("n")).collect()
    got = {r.third: r for r in merged.collect()}
    assert {r.third: r.n for r in exact}.keys() == got.keys() and all(got[r.third].approx_none == 0 for r in exact)
    assert all(abs(got[r.third].approx_u - r.n) <= 4 * 1.04 / 64 * r.n for r in exact)
    empty = sketches.count_sketches(df.where("false"), ["day"], ["u"])
    assert empty.count() == 0 and sketches.merge_sketches(empty, ["day"]).count() == 0


def test_set_sketches_give_overlaps(spark):
    """Exact below 2 ** lg_k values, within the bound above."""
    for n, exact in ((1000, True), (60_000, False)):
        df = spark.range(n).select(F.lit("all").alias("g"), F.col("id")).unionByName(spark.range(n // 2, n, 1).select(F.lit("half").alias("g"), "id"))
        sets = sketches.set_sketches(df.unionByName(spark.createDataFrame([("none", None)], "g string, id long")), ["g"], "id")
        pairs = sketches.overlaps(sets, sets.select(F.col("g").alias("h"), "set"), F.col("g") < F.col("h"))
        got = {(r.g, r.h): r for r in pairs.withColumn("ok", sketches.overlap_within_error(F.col("approx_both"), F.lit(n // 2), F.col("approx_union"))).collect()}
        both = got["all", "half"]
        assert both.ok and got["all", "none"].approx_both == 0 == got["half", "none"].approx_both
        assert not exact or (both.approx_both, both.approx_left_only, both.approx_union) == (n // 2, n // 2, n)


def test_folded_groups_never_make_large_frames(spark):
    """A group with two thirds of the rows, null and large keys, ties: results as of one frame, frames bounded."""
    from tessera.functions.udfs import fold_groups

    big = 2**60 + 1
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit(big)).when(F.col("id") % 300 == 0, F.lit(None)).otherwise(F.col("id") % 5).alias("g"),
                                    F.lit("x").alias("s"), (F.col("id") % 97).cast("double").alias("v")).repartition(5)

    def chunk(f):
        return [{"n": len(f), "top": sorted(f["v"], reverse=True)[:3], "chunk_rows": len(f), "merged": 0}]

    def merge(f):
        return {"n": int(f["n"].sum()), "top": sorted((x for t in f["top"] for x in t), reverse=True)[:3],
                "chunk_rows": int(f["chunk_rows"].max()), "merged": max(len(f), int(f["merged"].max()))}

    got = {r.g: r for r in fold_groups(df, ["g", "s"], chunk, merge, "n long, top array<double>, chunk_rows long, merged long", chunk_rows=50, fan_in=8).collect()}
    want = {r.g: r.n for r in df.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {g: r.n for g, r in got.items()} == want and want[big] == 20_000 and want[None] == 100
    assert all(r.top == [96.0] * 3 for g, r in got.items() if r.n > 1000)
    assert max(r.chunk_rows for r in got.values()) <= 50 and max(r.merged for r in got.values()) <= 8 * 4
    assert fold_groups(df.where("false"), ["g", "s"], chunk, merge, "n long, top array<double>, chunk_rows long, merged long").count() == 0


def test_active_spans(spark):
    from tessera.functions.udfs import active_spans

    days = [(1, 1), (1, 2), (1, 2), (1, 3), (1, 7), (2, 5), (None, 1), (None, 2), (3, None)]
    df = spark.createDataFrame([(u, d and dt.date(1970, 1, 1) + dt.timedelta(days=d)) for u, d in days], "u int, day date").repartition(4)
    assert rows(active_spans(df, ["u"], "day", chunk_rows=1, fan_in=2)) == [(None, [[1, 2]]), (1, [[1, 3], [7, 7]]), (2, [[5, 5]])]


def test_small_groups_are_folded_many_at_a_call(spark, monkeypatch):
    """Ten thousand users of a few days each: spans as by brute force, and a call folds many users."""
    from tessera.functions import udfs

    calls = spark.sparkContext.accumulator(0)
    whole = udfs.fold_groups

    def counted(df, by, chunk, merge, *rest, **more):
        def each(fold):
            def call(rows, *at):
                calls.add(1)
                return fold(rows, *at)
            return call
        return whole(df, by, each(chunk), each(merge), *rest, **more)

    monkeypatch.setattr(udfs, "fold_groups", counted)
    users, start = 10_000, dt.date(1969, 12, 30)
    df = spark.range(users * 8).select(F.when(F.col("id") % users != 7, F.col("id") % users).alias("u"),
                                       F.date_add(F.lit(start), F.pmod(F.xxhash64("id"), F.lit(12)).cast("int")).alias("day")).repartition(6)
    got = {r.u: [list(s) for s in r.spans] for r in udfs.active_spans(df, ["u"], "day", fan_in=4).collect()}
    want: dict = {}
    for u, day in sorted({(r.u, (r.day - dt.date(1970, 1, 1)).days) for r in df.collect()}, key=str):
        want.setdefault(u, set()).add(day)

    def spans(days):
        out = []
        for d in sorted(days):
            if out and out[-1][1] == d - 1:
                out[-1][1] = d
            else:
                out.append([d, d])
        return out

    assert got == {u: spans(days) for u, days in want.items()} and len(got) == users
    assert calls.value < users / 10


def test_statistics_are_broadcast_by_bytes_or_salted(spark):
    """A group with two thirds of the rows; null keys; both ways agree, and only the salted one shuffles the large side."""
    from tessera.operators.sizing import attach_statistics

    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 == 0, F.lit(None)).otherwise((F.col("id") % 7).cast("string")).alias("g"))
    stats = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    for how in ("inner", "left"):
        small, large = attach_statistics(df, stats, ["g"], how), attach_statistics(df, stats, ["g"], how, max_bytes=0, salts=5)
        assert rows(small, "id", "g", "n") == rows(large, "id", "g", "n") == rows(df.join(stats, ["g"], how), "id", "g", "n")
        plan = small._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    per_task = [r["count"] for r in large.groupBy(F.spark_partition_id()).count().collect()]
    assert max(per_task) < 0.6 * 3000


def test_money_is_never_rounded_in_silence(spark):
    from tessera.functions import money

    good = spark.createDataFrame([(0.1, 0.07), (9999999999.99, 0.0), (-3.0, 1.0), (None, 0.5)], "p double, d double")
    assert good.agg(money.total(money.net("p", "d")).alias("s")).first().s == 9999999999.99 + 0.093
    for p, d in ((0.105, 0.0), (1.0, 0.005), (1e10, 0.0), (float("nan"), 0.0)):
        with pytest.raises(Exception, match="decimal|DECIMAL|NaN|NUMERIC|CAST"):
            spark.createDataFrame([(p, d)], "p double, d double").agg(money.total(money.net("p", "d"))).collect()


def test_chi_square_by_hand(spark):
    """Empty cells, nulls left out, one level, no rows; cells are counted once."""
    from tessera.operators.experiments import chi_square

    data = [("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 30 + [("z", "q")] * 5 + [(None, "p"), ("x", None)]
    out = chi_square(spark.createDataFrame(data, "a string, b string"), "a", "b")
    got = out.first()
    table = np.array([[10, 20], [30, 0], [0, 5]], float)
    e = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    assert math.isclose(got.chi2, ((table - e) ** 2 / e).sum()) and (got.dof, got.n) == (2, 65)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert tuple(chi_square(spark.createDataFrame(data[:10], "a string, b string"), "a", "b").first()) == (0.0, 0, 10)
    assert chi_square(out.where("false").selectExpr("'a' as a", "'b' as b"), "a", "b").first().chi2 is None


def test_stack_allows_missing(spark):
    a = spark.createDataFrame([(1, "x")], "k long, s string")
    b = spark.createDataFrame([(2,)], "k long")
    assert rows(agg.stack(a, b)) == [(1, "x"), (2, None)]


def test_erfc_close_to_math(spark):
    from tessera.operators.experiments import p_value_udf, two_sided_p
    zs = [0.0, 0.5, 1.0, 1.959964, 3.0, -2.5]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    out = df.select("z", two_sided_p(F.col("z")).alias("p"), p_value_udf("z").alias("pu")).collect()
    for r in out:
        exact = math.erfc(abs(r["z"]) / math.sqrt(2))
        assert abs(r["p"] - exact) <= 2e-7 * max(exact, 1e-3)
        assert abs(r["pu"] - exact) < 1e-12


def test_tier_join_over_several_partitions(spark):
    rnd = random.Random(5)
    vals = [(i, rnd.choice([None, -3.0, 0.0, 5.0, 5.0, 9.99, 10.0, 15.0, 42.0, 7.0])) for i in range(300)]
    df = spark.createDataFrame(vals, "id long, x double")
    tiers = [("a", 0.0, 5.0), ("b", 5.0, 10.0), ("c", 12.0, 20.0)]
    want = [(i, next((t for t, lo, hi in tiers if x is not None and lo <= x < hi), None)) for i, x in vals]
    for n in (1, 5):
        assert rows(joins.tier_join(df, "x", spark.createDataFrame(tiers, "tier string, lo double, hi double"), partitions=n), "id", "tier") == want


def test_tier_join_is_typed_and_checks_its_ranges(spark):
    """Bigints beyond 2 ** 53, dates, text; an empty table; null, empty and overlapping ranges, also across partitions, raise."""
    big = 2**53
    df = spark.createDataFrame([(big - 1,), (big,), (big + 1,), (big + 2,), (None,)], "x long")
    tiers = spark.createDataFrame([("p", big, big + 1), ("q", big + 1, big + 2)], "tier string, lo long, hi long")
    assert rows(joins.tier_join(df, "x", tiers), "x", "tier") == [(None, None), (big - 1, None), (big, "p"), (big + 1, "q"), (big + 2, None)]
    days = spark.createDataFrame([(dt.date(2024, 1, 31),), (dt.date(2024, 2, 1),)], "d date")
    months = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 2, 1), 1)], "lo date, hi date, month int")
    assert rows(joins.tier_join(days, "d", months), "d", "month") == [(dt.date(2024, 1, 31), 1), (dt.date(2024, 2, 1), None)]
    words = spark.createDataFrame([("apple",), ("pear",)], "w string")
    assert rows(joins.tier_join(words, "w", spark.createDataFrame([("a", "b", 1)], "lo string, hi string, t int")), "w", "t") == [("apple", 1), ("pear", None)]
    assert rows(joins.tier_join(df, "x", tiers.where("false")), "tier") == [(None,)] * 5
    assert joins.tier_join(df.where("false"), "x", tiers).count() == 0
    many = [("t", i, i + 1) for i in range(0, 400, 2)]
    for bad in ([("a", 1, None)], [("a", None, 1)], [("a", 1, 1)], [("a", 2, 1)], [("a", 0, 3), ("b", 2, 5)], [*many, ("x", 100, 102)], [*many, ("x", -5, 300)], [("a", 1, 2)] * 2):
        with pytest.raises(ValueError):
            joins.tier_join(df, "x", spark.createDataFrame(bad, "tier string, lo long, hi long"), partitions=4)


def test_interval_join_ntz_uses_wall_clock(spark):
    """Wall-clock columns are compared as wall clock whatever the session zone
    (here across the end of daylight saving time in New York)."""
    a = spark.createDataFrame([(1, 1, dt.datetime(2024, 11, 3, 0, 30))], "aid long, u long, at timestamp_ntz")
    b = spark.createDataFrame([(2, 1, dt.datetime(2024, 11, 3, 6, 20))], "bid long, u long, bt timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert rows(joins.interval_join(a, b, "u", "at", "bt", "6 hours"), "aid", "bid") == [(1, 2)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_positions_over_shuffled_input(spark):
    """The input of with_positions is itself a shuffle output whose row order
    varies between evaluations; positions must still be exact."""
    from pyspark.sql import Window
    base = spark.range(0, 5000).select((F.col("id") % 997).alias("k"), (F.col("id") % 13).alias("g"))
    agg_ = base.groupBy("g", "k").agg(F.count(F.lit(1)).alias("c")).repartition(7)
    p = ordering.with_positions(agg_, ["-c", "k"], ["g"], running="c", partitions=6)
    w = Window.partitionBy("g").orderBy(F.col("c").desc(), "k")
    ref = agg_.select("g", "k", F.row_number().over(w).alias("rn"),
                      F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    assert rows(p, "g", "k", "_pos", "_cum") == rows(ref, "g", "k", "rn", "cum")


def test_bootstrap_reproducible_and_covers_mean(spark):
    from tessera.operators.experiments import bootstrap_mean_ci
    rnd = random.Random(11)
    df = spark.createDataFrame([(i, rnd.expovariate(0.1) + 1e9) for i in range(2000)] + [(-1, None)], "id long, v double")
    a = bootstrap_mean_ci(df, "v", reps=100, seed=3).first()
    b = bootstrap_mean_ci(df.repartition(7), "v", reps=100, seed=3).first()
    assert np.allclose(a[:4], b[:4], rtol=1e-12) and a != bootstrap_mean_ci(df, "v", reps=100, seed=4).first()
    values = [r[1] for r in df.collect() if r[1] is not None]
    assert math.isclose(a["mean"], np.mean(values), rel_tol=1e-12) and math.isclose(a["se"], np.std(values, ddof=1) / math.sqrt(2000), rel_tol=1e-6)
    assert a["ci_lo"] < a["mean"] < a["ci_hi"]
    # the interval is about 4 standard errors wide
    assert 2.5 * a["se"] < a["ci_hi"] - a["ci_lo"] < 6 * a["se"]


def test_bootstrap_of_few_and_hot_values(spark):
    """Counts of one value from 1 to millions give weights of the same law; no value, one value, equal values."""
    from tessera.operators.experiments import _resampled, bootstrap_mean_ci
    for n in (1, 2, 50, 9_999, 10_001, 3_000_000):
        w = _resampled(np.arange(40.0), np.full(40, n), 500, 7)
        assert abs(w.mean() - n) < 5 * math.sqrt(n / w.size) and abs(w.var() / n - 1) < 0.1
    assert (_resampled(np.array([3.0]), np.array([2]), 9, 7) == _resampled(np.array([1.0, 3.0]), np.array([2, 2]), 9, 7)[1]).all()
    none = bootstrap_mean_ci(spark.createDataFrame([(None,)], "v double"), "v").first()
    assert list(none) == [None, None, None, None, 200]
    one = bootstrap_mean_ci(spark.createDataFrame([(4.0,)], "v double"), "v").first()
    assert (one["mean"], one["se"], one["ci_lo"], one["ci_hi"]) == (4.0, None, 4.0, 4.0)
    hot = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(0).cast("long").alias("v"))
    got = bootstrap_mean_ci(hot, "v").first()
    se = math.sqrt(2 / 9 / 300_000)
    assert math.isclose(got["se"], se, rel_tol=1e-4) and abs(got["ci_lo"] - 1 / 3 + 1.96 * se) < se and abs(got["ci_hi"] - 1 / 3 - 1.96 * se) < se


def test_carry_forward_null_group_key(spark):
    data = [(1, None, ts(0), 5.0), (2, None, ts(2), None), (3, 1, ts(2), None)]
    df = spark.createDataFrame(data, "id long, u long, t timestamp_ntz, v double")
    out = joins.carry_forward(df, ["u"], "t", ["v"], tiebreak=["id"], grain="1 day")
    assert rows(out, "id", "v_ffill") == [(1, 5.0), (2, 5.0), (3, None)]


def test_hot_group_is_spread_over_ranges(spark):
    """A group holding a third of the rows lands in several range partitions,
    so no single task numbers it whole."""
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string")))
        .alias("g"), F.col("id").alias("v"))
    m = ordering.ranged(df, ["g", "v"], partitions=12)
    per = {r["_pid"]: r["n"] for r in m.where(F.col("g") == "hot").groupBy("_pid").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert len(per) >= 3 and max(per.values()) < 1000


def test_orphans_and_key_violations(spark):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 12), (5, 12)], "id long, fk long")
    parent = spark.createDataFrame([(10,), (12,), (12,)], "pk long")
    assert rows(cl.orphans(child, parent, "fk", "pk"), "id") == [(2,), (3,)]
    rep = cl.orphan_report([("child.fk", child, parent, "fk", "pk")]).first()
    assert (rep["fk"], rep["n_orphans"]) == ("child.fk", 2)
    assert rows(cl.key_violations(child, ["fk"])) == [(12, 2)]


def test_duplicate_groups_normalise_case_and_space(spark):
    df = spark.createDataFrame([(1, "Hello  World"), (2, "hello world "), (3, "other"), (4, None)],
                               "id long, text string")
    got = cl.duplicate_groups(df, "text", "id").collect()
    assert [(r["n_docs"], r["min_id"], r["max_id"]) for r in got] == [(2, 1, 2)]
    assert cl.duplicate_groups(df, "text", "id", normalise=False).count() == 0


def test_divisions_by_zero_give_null(spark):
    from tessera.functions.scalar import cosine
    from tessera.operators import experiments
    v = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert v.select(cosine(F.col("a"), F.col("b")).alias("c")).first()["c"] is None
    w = spark.createDataFrame([("x", 1.0), ("x", 1.0), ("y", 2.0), ("y", 2.0)], "g string, v double")
    r = experiments.welch_test(w, F.col("g"), "v", "x", "y").first()
    assert r["t"] is None and r["dof"] is None


def test_asof_join_nulls_match_nothing(spark):
    left = spark.sql("SELECT * FROM VALUES (1, CAST(NULL AS INT), TIMESTAMP_NTZ'2024-01-02 00:00:00'), (2, 7, CAST(NULL AS TIMESTAMP_NTZ)), "
                     "(3, 7, TIMESTAMP_NTZ'2024-01-02 00:00:00') AS t(id, k, lt)")
    right = spark.sql("SELECT * FROM VALUES (CAST(NULL AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00', 'a'), (7, CAST(NULL AS TIMESTAMP_NTZ), 'b') AS t(k, rt, v)")
    from tessera.operators.joins import asof_join
    got = asof_join(left, right, ["k"], "lt", "rt", ["v"])
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [(1, None), (2, None), (3, None)]
