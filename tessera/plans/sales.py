"""Jobs on the sales star (lineitem, orders, customer, nation, region)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import money
from tessera.operators import aggregates as agg
from tessera.operators.sizing import bounded_broadcast
from tessera.plans.registry import register, tables

# nation x region is bounded by the number of nations; checked before broadcast.
_GEO_MAX_ROWS = 10_000


def _net(c_price="l_extendedprice", c_disc="l_discount"):
    return F.col(c_price) * (1 - F.col(c_disc))


def revenue_by_geo(t):
    """Revenue and line counts per customer nation, pre-aggregated before each
    join: lineitem is reduced per order (partial aggregate, then a shuffle on
    the order key that the orders join reuses), then per customer, so the
    customer join and the rollup see one row per customer, not per line."""
    per_order = (t.lineitem
                 .groupBy("l_orderkey")
                 .agg(F.sum(money.net()).alias("rev"), F.count(F.lit(1)).alias("n_lines")))
    orders = t.orders.select("o_orderkey", "o_custkey")
    per_cust = (per_order.join(orders, per_order.l_orderkey == orders.o_orderkey)
                .groupBy("o_custkey")
                .agg(F.sum("rev").alias("rev"), F.sum("n_lines").alias("n_lines")))
    cust = t.customer.select("c_custkey", "c_nationkey")
    geo = bounded_broadcast(
        t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name", "r_name"), _GEO_MAX_ROWS)
    return (per_cust.join(cust, per_cust.o_custkey == cust.c_custkey)
            .join(geo, F.col("c_nationkey") == F.col("n_nationkey")))


@register("revenue_rollup", sql=f"""
SELECT r_name, n_name, CAST(grouping(r_name, n_name) AS BIGINT) AS level,
       CAST(sum({money.NET_SQL}) AS DOUBLE) AS revenue,
       count(*) AS n_lines
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name)
""")
def revenue_rollup(spark, sf_dir):
    """Flagship (P01, P17, P19, P28): revenue by region and nation with subtotals."""
    t = tables(spark, sf_dir)
    # one row per nation before the rollup: its Expand then copies 25 rows, not customers
    per_nation = (revenue_by_geo(t).groupBy("r_name", "n_name")
                  .agg(F.sum("rev").alias("rev"), F.sum("n_lines").alias("n_lines")))
    out = agg.subtotals(per_nation, ["r_name", "n_name"],
                        [F.sum("rev").cast("double").alias("revenue"),
                         F.sum("n_lines").cast("long").alias("n_lines")])
    return out.select("r_name", "n_name", F.col("level").cast("long").alias("level"),
                      "revenue", "n_lines")


def _per_order(t):
    return (t.lineitem.groupBy("l_orderkey")
            .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(money.net()).alias("rev")))


@register("orders_line_totals", sql=f"""
SELECT o_orderkey, l.n_lines, CAST(l.rev AS DOUBLE) AS revenue
FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) AS n_lines, sum({money.NET_SQL}) AS rev
  FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l.l_orderkey
""")
def orders_line_totals(spark, sf_dir):
    """P20 left_enrich: every order with its line count and revenue (null when
    it has no lines)."""
    from tessera.operators.joins import left_enrich
    t = tables(spark, sf_dir)
    per = _per_order(t).withColumnRenamed("l_orderkey", "o_orderkey")
    out = left_enrich(t.orders.select("o_orderkey"), per, ["o_orderkey"])
    return out.select("o_orderkey", "n_lines", F.col("rev").cast("double").alias("revenue"))


@register("orders_without_lines", sql="""
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
""")
def orders_without_lines(spark, sf_dir):
    """P21 without_match (left anti join)."""
    from tessera.operators.joins import without_match
    t = tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    return without_match(o, t.lineitem.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))


@register("orders_with_lines", sql="""
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
""")
def orders_with_lines(spark, sf_dir):
    """P21 with_match (left semi join)."""
    from tessera.operators.joins import with_match
    t = tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    return with_match(o, t.lineitem.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))


@register("line_summary_by_flags", sql=f"""
SELECT l_returnflag, l_linestatus,
       round(sum(l_quantity), 2) AS sum_qty,
       CAST(sum({money.price_sql("l_extendedprice")}) AS DOUBLE) AS sum_price,
       CAST(sum({money.NET_SQL}) AS DOUBLE) AS sum_net,
       round(avg(l_quantity), 6) AS avg_qty,
       round(avg(l_discount), 6) AS avg_disc,
       min(l_discount) + 0.0 AS min_disc,
       max(l_tax) AS max_tax,
       round(var_samp(l_quantity), 6) AS var_qty,
       round(stddev_samp(l_extendedprice), 6) AS sd_price,
       count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def line_summary_by_flags(spark, sf_dir):
    """P27 summarise: sum / avg / min / max / count / variance per group."""
    t = tables(spark, sf_dir)
    return (t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        money.total(money.price("l_extendedprice")).alias("sum_price"),
        money.total(money.net()).alias("sum_net"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        (F.min("l_discount") + 0.0).alias("min_disc"),
        F.max("l_tax").alias("max_tax"),
        F.round(F.var_samp("l_quantity"), 6).alias("var_qty"),
        F.round(F.stddev_samp("l_extendedprice"), 6).alias("sd_price"),
        F.count(F.lit(1)).alias("n")))


@register("segment_priority_cube", sql="""
SELECT c_mktsegment, o_orderpriority, count(*) AS n,
       CAST(grouping(c_mktsegment, o_orderpriority) AS BIGINT) AS level
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY CUBE (c_mktsegment, o_orderpriority)
""")
def segment_priority_cube(spark, sf_dir):
    """P29 crosstab: orders by market segment x priority with all margins."""
    t = tables(spark, sf_dir)
    j = t.orders.select("o_custkey", "o_orderpriority").join(
        t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    out = agg.crosstab(j, "c_mktsegment", "o_orderpriority")
    return out.withColumn("level", F.col("level").cast("long"))


@register("flag_grouping_sets", sql="""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n,
       CAST(grouping(l_linestatus, l_returnflag) AS BIGINT) AS level
FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())
""")
def flag_grouping_sets(spark, sf_dir):
    """P30 grouping_sets: chosen grouping sets in one aggregate."""
    t = tables(spark, sf_dir)
    # per (flag, status) cell first; the grouping sets then expand cells, not lines
    cells = (t.lineitem.groupBy("l_returnflag", "l_linestatus")
             .agg(F.sum("l_quantity").alias("_q"), F.count(F.lit(1)).alias("_n")))
    out = agg.grouping_sets(
        cells, [["l_returnflag", "l_linestatus"], ["l_returnflag"], ["l_linestatus"], []],
        [F.round(F.sum("_q"), 2).alias("sum_qty"), F.sum("_n").cast("long").alias("n")])
    return out.withColumn("level", F.col("level").cast("long"))


@register("price_quantity_relation", sql="""
SELECT l_returnflag,
       round(corr(l_quantity, l_extendedprice), 8) AS corr,
       round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(covar_samp(l_quantity, l_extendedprice), 4) AS covar,
       round(regr_r2(l_extendedprice, l_quantity), 8) AS r2,
       count(*) AS n
FROM lineitem GROUP BY l_returnflag
""")
def price_quantity_relation(spark, sf_dir):
    """P37 relate: correlation, slope, intercept, covariance, r2 per return flag."""
    t = tables(spark, sf_dir)
    r = agg.relate(t.lineitem, "l_quantity", "l_extendedprice", by=["l_returnflag"])
    return r.select("l_returnflag", F.round("corr", 8).alias("corr"),
                    F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"),
                    F.round("covar", 4).alias("covar"), F.round("r2", 8).alias("r2"), "n")


@register("top_customers_per_nation", sql="""
SELECT c_nationkey, c_custkey, c_acctbal, rn FROM (
  SELECT c_nationkey, c_custkey, c_acctbal,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn
  FROM customer) WHERE rn <= 3
""")
def top_customers_per_nation(spark, sf_dir):
    """P38 top_n_per_group: three richest customers per nation."""
    t = tables(spark, sf_dir)
    c = t.customer.select("c_nationkey", "c_custkey", "c_acctbal")
    out = agg.top_n_per_group(c, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3)
    return out.withColumn("rn", F.col("rn").cast("long"))


@register("top_orders", sql="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 10
""")
def top_orders(spark, sf_dir):
    """P44 top_k: the ten largest orders (the limit is the feature)."""
    t = tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return agg.top_k(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)


@register("orders_stacked", sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
UNION ALL BY NAME
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice
FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'
""")
def orders_stacked(spark, sf_dir):
    """P45 stack: union by name of two cuts, the later one lacking a column."""
    t = tables(spark, sf_dir)
    o = t.orders
    early = o.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    late = o.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return agg.stack(early, late)


def _flag_cuts(t):
    li = t.lineitem
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    a = li.where(F.col("l_shipdate") < cut).select("l_partkey", "l_returnflag")
    b = li.where(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).select(
        "l_partkey", "l_returnflag")
    return a, b


_CUT_A = ("SELECT l_partkey, l_returnflag FROM lineitem "
          "WHERE l_shipdate < TIMESTAMP '1998-01-01'")
_CUT_B = ("SELECT l_partkey, l_returnflag FROM lineitem "
          "WHERE l_shipdate >= TIMESTAMP '1997-01-01'")


@register("parts_flags_intersect_all", sql=f"{_CUT_A} INTERSECT ALL {_CUT_B}")
def parts_flags_intersect_all(spark, sf_dir):
    """P46 common (multiset)."""
    a, b = _flag_cuts(tables(spark, sf_dir))
    return agg.common(a, b, all=True)


@register("parts_flags_intersect", sql=f"{_CUT_A} INTERSECT {_CUT_B}")
def parts_flags_intersect(spark, sf_dir):
    """P46 common (set)."""
    a, b = _flag_cuts(tables(spark, sf_dir))
    return agg.common(a, b)


@register("parts_flags_except_all", sql=f"{_CUT_A} EXCEPT ALL {_CUT_B}")
def parts_flags_except_all(spark, sf_dir):
    """P46 difference (multiset)."""
    a, b = _flag_cuts(tables(spark, sf_dir))
    return agg.difference(a, b, all=True)


@register("parts_flags_except", sql=f"{_CUT_A} EXCEPT {_CUT_B}")
def parts_flags_except(spark, sf_dir):
    """P46 difference (set)."""
    a, b = _flag_cuts(tables(spark, sf_dir))
    return agg.difference(a, b)


@register("line_net_prices", sql="""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       l_extendedprice * (1 - l_discount) AS net,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT)
         AS ship_lag_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def line_net_prices(spark, sf_dir):
    """P17 derive: computed columns (net and gross price, days from order to ship)."""
    t = tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", "o_orderdate")
    j = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        _net().alias("net"),
        (_net() * (1 + F.col("l_tax"))).alias("gross"),
        F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long")
        .alias("ship_lag_days"))


@register("open_high_value_orders", sql="""
SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
WHERE o_orderstatus = 'O' AND o_totalprice > 400000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')
""")
def open_high_value_orders(spark, sf_dir):
    """P18 segment_filter: the predicate reaches the parquet scan (PushedFilters)."""
    t = tables(spark, sf_dir)
    pred = ((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 400000)
            & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return t.orders.where(pred).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
