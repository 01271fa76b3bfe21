"""Jobs: tiers, reconciliation, distinct counts, quantiles, pivots, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import money
from tessera.operators import aggregates as agg
from tessera.operators import joins, ordering, sketches
from tessera.plans.registry import register, tables

# Account balance tiers, half-open [lo, hi).
BALANCE_TIERS = [
    ("negative", -1.0e12, 0.0),
    ("low", 0.0, 2500.0),
    ("mid", 2500.0, 7500.0),
    ("high", 7500.0, 1.0e12),
]
_TIER_VALUES = ", ".join(f"('{n}', {lo}::DOUBLE, {hi}::DOUBLE)" for n, lo, hi in BALANCE_TIERS)


@register("customer_balance_tiers", sql=f"""
SELECT c_custkey, c_acctbal, tier
FROM customer LEFT JOIN (VALUES {_TIER_VALUES}) AS t(tier, lo, hi)
  ON c_acctbal >= lo AND c_acctbal < hi
""")
def customer_balance_tiers(spark, sf_dir):
    """P23 tier_join: balance to tier, starts and values sorted together."""
    t = tables(spark, sf_dir)
    tiers = spark.createDataFrame(BALANCE_TIERS, "tier string, lo double, hi double")
    c = t.customer.select("c_custkey", "c_acctbal")
    return joins.tier_join(c, "c_acctbal", tiers).select("c_custkey", "c_acctbal", "tier")


_RECON_A = "SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'"
_RECON_B = ("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' "
            "THEN o_totalprice + 1.0 ELSE o_totalprice END AS o_totalprice "
            "FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")


@register("orders_reconcile", sql=f"""
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
       CASE WHEN b.o_orderkey IS NULL THEN 'only_a'
            WHEN a.o_orderkey IS NULL THEN 'only_b' ELSE 'changed' END AS status,
       a.o_orderstatus AS o_orderstatus_a, b.o_orderstatus AS o_orderstatus_b,
       a.o_totalprice AS o_totalprice_a, b.o_totalprice AS o_totalprice_b
FROM ({_RECON_A}) a FULL OUTER JOIN ({_RECON_B}) b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL
   OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
   OR a.o_totalprice IS DISTINCT FROM b.o_totalprice
""")
def orders_reconcile(spark, sf_dir):
    """P22 reconcile: two overlapping cuts of orders, the second with open
    orders repriced; rows only in one cut and changed rows."""
    t = tables(spark, sf_dir)
    o = t.orders
    a = o.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    b = (o.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
         .withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") + 1.0)
                     .otherwise(F.col("o_totalprice"))))
    return joins.reconcile(a, b, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@register("distinct_users_by_type", sql="""
SELECT event_type, count(DISTINCT user_id) AS n_user_id, count(DISTINCT props) AS n_props
FROM events GROUP BY event_type
""")
def distinct_users_by_type(spark, sf_dir):
    """P31 distinct_counts (exact)."""
    t = tables(spark, sf_dir)
    return agg.distinct_counts(t.events, ["event_type"], ["user_id", "props"])


@register("approx_distinct_users", sql="""
SELECT event_type, count(DISTINCT user_id) AS n_user_id, count(DISTINCT event_id) AS n_event_id,
       true AS approx_user_id_within, true AS hll_user_id_within, true AS approx_event_id_within, true AS hll_event_id_within
FROM events GROUP BY event_type
""")
def approx_distinct_users(spark, sf_dir):
    """P32 distinct_counts_approx: exact distinct users and events per type, and whether
    the sketched counts lie within four standard errors of them (rsd 0.02; 1.04 / 64
    for the mergeable sketch)."""
    e = tables(spark, sf_dir).events
    both = agg.distinct_counts(e, ["event_type"], ["user_id", "event_id"]).join(
        agg.distinct_counts_approx(e, ["event_type"], ["user_id", "event_id"]).withColumnRenamed("event_type", "_type"),
        F.col("event_type").eqNullSafe(F.col("_type")))
    flags = []
    for c in ("user_id", "event_id"):
        n = F.col(f"n_{c}")
        flags += [(F.abs(F.col(f"approx_{c}") - n) <= F.greatest(F.lit(1.0), 4 * 0.02 * n)).alias(f"approx_{c}_within"),
                  sketches.within_error(F.col(f"hll_{c}"), n).alias(f"hll_{c}_within")]
    return both.select("event_type", "n_user_id", "n_event_id", *flags)


_GRAINS = ("day", "week", "month")


@register("user_sketch_rollup", sql=" UNION ALL ".join(f"""
SELECT '{g}' AS grain, CAST(date_trunc('{g}', ts) AS DATE) AS period_start, event_type,
       count(DISTINCT user_id) AS n_users, count(DISTINCT event_id) AS n_events, true AS users_within, true AS events_within
FROM events GROUP BY 2, 3""" for g in _GRAINS))
def user_sketch_rollup(spark, sf_dir):
    """P32 stored sketches: a table of daily sketches per type, merged into weeks and months
    without reading the events again; the exact counts beside them tell whether the
    estimates lie within four standard errors."""
    e = tables(spark, sf_dir).events.select(F.to_date("ts").alias("day"), "event_type", "user_id", "event_id")
    daily = sketches.count_sketches(e, ["day", "event_type"], ["user_id", "event_id"], store="daily-sketches")
    out = None
    for grain in _GRAINS:
        period = (F.col("day") if grain == "day" else F.trunc("day", grain)).alias("period_start")
        merged = sketches.sketched_counts(sketches.merge_sketches(daily, [period, "event_type"]))
        exact = e.groupBy(period, "event_type").agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("event_id").alias("n_events"))
        met = exact.join(merged.select(F.col("period_start").alias("_p"), F.col("event_type").alias("_t"), "approx_user_id", "approx_event_id"),
                         F.col("period_start").eqNullSafe(F.col("_p")) & F.col("event_type").eqNullSafe(F.col("_t")))
        part = met.select(F.lit(grain).alias("grain"), "period_start", "event_type", "n_users", "n_events",
                          sketches.within_error(F.col("approx_user_id"), F.col("n_users")).alias("users_within"),
                          sketches.within_error(F.col("approx_event_id"), F.col("n_events")).alias("events_within"))
        out = part if out is None else out.unionByName(part)
    return out


@register("users_back_next_day", sql="""
WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events WHERE user_id IS NOT NULL),
     days AS (SELECT DISTINCT day FROM d)
SELECT a.day, (SELECT count(*) FROM d x WHERE x.day = a.day) AS n_users,
       (SELECT count(*) FROM d x JOIN d y ON x.user_id = y.user_id AND x.day = a.day AND y.day = a.day + 1) AS n_back,
       true AS back_within
FROM days a JOIN days b ON b.day = a.day + 1
""")
def users_back_next_day(spark, sf_dir):
    """P32 set sketches: users of a day who are there on the next one too, from the
    intersection of stored daily sketches, beside the exact count."""
    d = tables(spark, sf_dir).events.where(F.col("user_id").isNotNull()).select(F.to_date("ts").alias("day"), "user_id").distinct()
    sets = sketches.set_sketches(d, ["day"], "user_id", store="daily-sets")
    pairs = sketches.overlaps(sets, sets.select(F.col("day").alias("next_day"), "set"), F.col("next_day") == F.date_add("day", 1))
    after = d.select(F.date_sub("day", 1).alias("day"), "user_id", F.lit(1).alias("back"))
    exact = d.join(after, ["day", "user_id"], "left").groupBy("day").agg(F.count(F.lit(1)).alias("n_users"), F.count("back").alias("n_back"))
    return exact.join(pairs, "day").select("day", "n_users", "n_back", sketches.overlap_within_error(
        F.col("approx_both"), F.col("n_back"), F.col("approx_union")).alias("back_within"))


@register("event_value_quantiles", sql="""
SELECT event_type,
       round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
       round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.9), 6) AS q90
FROM events GROUP BY event_type
""")
def event_value_quantiles(spark, sf_dir):
    """P33 quantiles: exact interpolated quartiles and p90 per event type."""
    t = tables(spark, sf_dir)
    q = ordering.exact_quantiles(t.events, "value", [0.25, 0.5, 0.75, 0.9], by=["event_type"],
                                 tiebreak=["event_id"])
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75", "q90")])


@register("segment_status_pivot", sql="""
SELECT c_mktsegment,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS "F",
       count(*) FILTER (WHERE o_orderstatus = 'O') AS "O",
       count(*) FILTER (WHERE o_orderstatus = 'P') AS "P"
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
""")
def segment_status_pivot(spark, sf_dir):
    """P34 pivot_counts: order counts by segment, one column per status."""
    t = tables(spark, sf_dir)
    j = t.orders.select("o_custkey", "o_orderstatus").join(
        t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return agg.pivot_counts(j, ["c_mktsegment"], "o_orderstatus", ["F", "O", "P"])


@register("nation_long", sql="""
UNPIVOT (SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation)
ON n_name, n_regionkey INTO NAME attribute VALUE value
""")
def nation_long(spark, sf_dir):
    """P35 to_long: wide to long."""
    t = tables(spark, sf_dir)
    n = t.nation.select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("n_regionkey"))
    return agg.to_long(n, ["n_nationkey"], ["n_name", "n_regionkey"])


@register("part_price_ranks", sql="""
SELECT p_partkey, p_type, p_retailprice,
       rank() OVER w AS rnk, dense_rank() OVER w AS drnk,
       percent_rank() OVER w AS prank, cume_dist() OVER w AS cdist
FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_retailprice)
""")
def part_price_ranks(spark, sf_dir):
    """P39 rank_all: rank, dense_rank, percent_rank, cume_dist per part type,
    from range-partitioned positions (six types would be six tasks otherwise)."""
    t = tables(spark, sf_dir)
    p = t.part.select("p_partkey", "p_type", "p_retailprice")
    r = ordering.rank_all(p, ["p_type"], "p_retailprice", ["p_partkey"])
    return r.select("p_partkey", "p_type", "p_retailprice", "rnk", "drnk",
                    "prank", "cdist")


@register("supplier_top_revenue_per_nation", sql=f"""
WITH r AS (SELECT l_suppkey, CAST(sum({money.NET_SQL}) AS DOUBLE) AS revenue
           FROM lineitem GROUP BY 1),
     s AS (SELECT s_nationkey, s_suppkey, s_name, revenue,
                  row_number() OVER (PARTITION BY s_nationkey ORDER BY revenue DESC, s_suppkey) AS rn
           FROM supplier JOIN r ON s_suppkey = l_suppkey)
SELECT s_nationkey, s_suppkey, s_name, revenue, rn FROM s WHERE rn <= 3
""")
def supplier_top_revenue_per_nation(spark, sf_dir):
    """P27 + P38 on the supplier side: revenue per supplier (partial aggregate
    before the supplier join), then the three best suppliers per nation."""
    t = tables(spark, sf_dir)
    rev = (t.lineitem.groupBy("l_suppkey")
           .agg(money.total(money.net()).alias("revenue")))
    s = t.supplier.select("s_nationkey", "s_suppkey", "s_name")
    j = s.join(rev, F.col("s_suppkey") == F.col("l_suppkey")).drop("l_suppkey")
    out = agg.top_n_per_group(j, ["s_nationkey"], [F.col("revenue").desc(), F.col("s_suppkey")], 3)
    return out.withColumn("rn", F.col("rn").cast("long"))
