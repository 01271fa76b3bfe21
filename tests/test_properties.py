"""Property tests: the scale-safe operators against Spark's one-task windows
or a brute-force answer, on random small tables with hot keys and ties."""

import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from support import rows
from tessera.operators import joins, ordering

SETTINGS = settings(max_examples=6, deadline=None)

# groups skewed towards "hot"; values with many ties and some nulls
groups = st.sampled_from(["hot", "hot", "hot", "a", "b"])
values = st.one_of(st.none(), st.integers(min_value=0, max_value=6).map(float))
table = st.lists(st.tuples(groups, values), min_size=1, max_size=60)


def _df(spark, data):
    return spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(data)], "id long, g string, v double")


@SETTINGS
@given(table)
def test_positions_match_row_number(spark, data):
    df = _df(spark, data)
    w = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last(), "id")
    ref = df.select("id", F.row_number().over(w).alias("p"),
                    F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    got = ordering.with_positions(df, ["-v", "id"], ["g"], running="v", partitions=3)
    assert rows(got, "id", "_pos", "_cum") == rows(ref, "id", "p", "c")


@SETTINGS
@given(table)
def test_ranks_match_sql(spark, data):
    df = _df(spark, data)
    w = Window.partitionBy("g").orderBy("v")
    ref = df.select("id", F.rank().over(w), F.dense_rank().over(w), F.percent_rank().over(w),
                    F.cume_dist().over(w))
    got = ordering.rank_all(df, ["g"], "v", partitions=3)
    assert rows(got, "id", "rnk", "drnk", "prank", "cdist") == rows(ref)


@SETTINGS
@given(table, st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]), min_size=1, max_size=3, unique=True))
def test_quantiles_match_numpy(spark, data, qs):
    df = _df(spark, data)
    names = [f"x{i}" for i in range(len(qs))]
    got = {r["g"]: [r[n] for n in names]
           for r in ordering.exact_quantiles(df, "v", qs, ["g"], names=names, partitions=3).collect()}
    for g in {g for g, v in data if v is not None}:
        vals = [v for gg, v in data if gg == g and v is not None]
        assert np.allclose(got[g], np.percentile(vals, [q * 100 for q in qs]))


events = st.lists(st.tuples(st.sampled_from([1, 1, 1, 2]), st.integers(min_value=0, max_value=72 * 60),
                            st.one_of(st.none(), st.floats(min_value=0, max_value=9, allow_nan=False))),
                  min_size=1, max_size=50)


def _ev(spark, data):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, u, base + dt.timedelta(minutes=m), v) for i, (u, m, v) in enumerate(data)],
                                 "id long, u long, t timestamp_ntz, v double")


@SETTINGS
@given(events)
def test_carry_forward_matches_window(spark, data):
    df = _ev(spark, data)
    w = Window.partitionBy("u").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("id", F.last("v", ignorenulls=True).over(w).alias("f"))
    got = joins.carry_forward(df, ["u"], "t", ["v"], tiebreak=["id"], grain="6 hours")
    assert rows(got, "id", "v_ffill") == rows(ref, "id", "f")


@SETTINGS
@given(events, st.sampled_from(["30 minutes", "2 hours", "1 day"]))
def test_interval_join_matches_brute_force(spark, data, within):
    df = _ev(spark, data)
    a = df.select(F.col("id").alias("aid"), "u", F.col("t").alias("at"))
    b = df.select(F.col("id").alias("bid"), "u", F.col("t").alias("bt"))
    got = rows(joins.interval_join(a, b, "u", "at", "bt", within), "aid", "bid")
    n, unit = within.split()
    span = dt.timedelta(minutes=int(n) * {"minutes": 1, "hours": 60, "day": 1440}[unit])
    exp = sorted((i, j) for i, (ui, mi, _) in enumerate(data) for j, (uj, mj, _) in enumerate(data)
                 if ui == uj and 0 <= (mj - mi) and dt.timedelta(minutes=mj - mi) <= span)
    assert got == exp


@SETTINGS
@given(events, st.sampled_from(["1 hour", "12 hours"]))
def test_sessions_match_lag_rule(spark, data, gap):
    from tessera.operators.customers import sessions
    df = _ev(spark, data)
    w = Window.partitionBy("u").orderBy("t", "id")
    marked = df.withColumn("prev", F.lag("t").over(w)).withColumn(
        "start", (F.col("prev").isNull() | (F.col("t") >= F.col("prev") + F.expr(f"INTERVAL {gap}"))).cast("int"))
    ref = (marked.withColumn("sid", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .groupBy("u", "sid").agg(F.min("t").alias("s"), F.count(F.lit(1)).alias("n")))
    got = sessions(df, "u", "t", gap, tiebreak=["id"], grain="6 hours", cut_lineage=False)
    assert rows(got, "u", "session_start", "n_events") == rows(ref, "u", "s", "n")


@SETTINGS
@given(events, events)
def test_asof_matches_brute_force(spark, left, right):
    base = dt.datetime(2024, 1, 1)
    l = spark.createDataFrame([(i, u, base + dt.timedelta(minutes=m)) for i, (u, m, _) in enumerate(left)],
                              "lid long, u long, lt timestamp_ntz")
    r = spark.createDataFrame([(i, u, base + dt.timedelta(minutes=m)) for i, (u, m, _) in enumerate(right)],
                              "rid long, u long, rt timestamp_ntz")
    got = rows(joins.asof_join(l, r, ["u"], "lt", "rt", ["rid"], right_tiebreak=["rid"], grain="6 hours"),
               "lid", "rid")
    exp = []
    for i, (u, m, _) in enumerate(left):
        cands = [(mm, j) for j, (uu, mm, _) in enumerate(right) if uu == u and mm <= m]
        exp.append((i, max(cands)[1] if cands else None))
    assert got == sorted(exp, key=lambda t: (t[0], t[1] is not None, t[1]))


steps_events = st.lists(st.tuples(st.sampled_from([1, 1, 2, 3]), st.integers(min_value=0, max_value=100),
                                  st.sampled_from(["a", "b", "c", "x"])), min_size=0, max_size=40)


@SETTINGS
@given(steps_events)
def test_funnel_matches_brute_force(spark, data):
    from tessera.operators.customers import funnel
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(u, base + dt.timedelta(hours=h), e) for u, h, e in data],
                               "u long, t timestamp_ntz, e string")
    got = rows(funnel(df, "u", "t", "e", ["a", "b", "c"], "48 hours"), "step", "n_users")
    counts = [0, 0, 0]
    for u in {r[0] for r in data}:
        ev = sorted((h, e) for uu, h, e in data if uu == u)
        firsts = [h for h, e in ev if e == "a"]
        if not firsts:
            continue
        t1 = min(firsts)
        counts[0] += 1
        tk = t1
        for k, s in enumerate(["b", "c"], start=1):
            nxt = [h for h, e in ev if e == s and tk < h <= t1 + 48]
            if not nxt:
                break
            tk = min(nxt)
            counts[k] += 1
    assert got == [(1, counts[0]), (2, counts[1]), (3, counts[2])]


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from([1, 1, 1, 2, 3]), st.integers(min_value=0, max_value=5)),
                min_size=1, max_size=40))
def test_dedupe_latest_matches_python(spark, data):
    from tessera.operators.cleaning import dedupe_latest
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(data)], "k long, t long, id long")
    got = rows(dedupe_latest(df, ["k"], ["t", "id"]), "k", "id")
    best = {}
    for i, (k, t) in enumerate(data):
        if k not in best or (t, i) > best[k]:
            best[k] = (t, i)
    assert got == sorted((k, i) for k, (t, i) in best.items())
