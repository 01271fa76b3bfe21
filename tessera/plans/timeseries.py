"""Jobs: forward fill, period change, moving and trailing windows, calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import money
from tessera.operators import timeseries as ts_ops
from tessera.plans.registry import register, tables


@register("events_forward_fill", sql="""
SELECT event_id, user_id,
       last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
         OVER (PARTITION BY user_id ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase_value
FROM events
""")
def events_forward_fill(spark, sf_dir):
    """P13 forward_fill: each event carries the user's last purchase value so far."""
    t = tables(spark, sf_dir)
    e = t.events.select("event_id", "user_id", "ts",
                        F.when(F.col("event_type") == "purchase", F.col("value")).alias("pv"))
    out = ts_ops.forward_fill(e, "pv", ["user_id"], "ts", tiebreak=["event_id"])
    return out.select("event_id", "user_id", F.col("pv_ffill").alias("last_purchase_value"))


@register("monthly_revenue_change", sql=f"""
WITH m AS (
  SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CAST(sum({money.price_sql("o_totalprice")}) AS DOUBLE) AS revenue
  FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, month, revenue, lag(revenue) OVER w AS prev_revenue,
       (revenue - lag(revenue) OVER w) / nullif(lag(revenue) OVER w, 0) AS growth
FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month)
""")
def monthly_revenue_change(spark, sf_dir):
    """P40 period_change: month-over-month revenue growth per priority."""
    t = tables(spark, sf_dir)
    m = (t.orders.groupBy("o_orderpriority", F.trunc(F.to_date("o_orderdate"), "month").alias("month"))
         .agg(money.total(money.price("o_totalprice")).alias("revenue")))
    return ts_ops.period_change(m, ["o_orderpriority"], "month", "revenue")


@register("daily_events_ma7", sql="""
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, day, n,
       round(avg(n) OVER (PARTITION BY event_type ORDER BY day
                          ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma7
FROM d
""")
def daily_events_ma7(spark, sf_dir):
    """P41 moving_average: 7-row moving mean of daily events per type."""
    t = tables(spark, sf_dir)
    d = (t.events.groupBy("event_type", F.to_date("ts").alias("day"))
         .agg(F.count(F.lit(1)).alias("n")))
    out = ts_ops.moving_average(d, ["event_type"], "day", "n", 7, name="ma7")
    return out.withColumn("ma7", F.round("ma7", 6))


@register("orders_trailing_7d", sql=f"""
WITH d AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS n_orders,
                  sum({money.price_sql("o_totalprice")}) AS revenue
           FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, day, n_orders, CAST(revenue AS DOUBLE) AS revenue,
       CAST(sum(n_orders) OVER w AS BIGINT) AS n_orders_7d, CAST(sum(revenue) OVER w AS DOUBLE) AS revenue_7d
FROM d WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day
                    RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)
""")
def orders_trailing_7d(spark, sf_dir):
    """P42 trailing_interval: 7 calendar days of orders (not 7 rows)."""
    t = tables(spark, sf_dir)
    d = (t.orders.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day"))
         .agg(F.count(F.lit(1)).alias("n_orders"), F.sum(money.price("o_totalprice")).alias("revenue")))
    out = ts_ops.trailing_interval(d, ["o_orderpriority"], "day", ["n_orders", "revenue"], 7)
    return out.withColumns({"revenue": F.col("revenue").cast("double"),
                            "revenue_7d": F.col("revenue_7d").cast("double")})


@register("user_daily_activity", sql="""
WITH b AS (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events),
     u AS (SELECT DISTINCT user_id FROM events),
     cal AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
             FROM u, b),
     c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_events FROM events GROUP BY 1, 2)
SELECT cal.user_id, cal.day, coalesce(c.n_events, 0) AS n_events
FROM cal LEFT JOIN c ON cal.user_id = c.user_id AND cal.day = c.day
""")
def user_daily_activity(spark, sf_dir):
    """P43 calendar_fill: events per user and day, zero on days without events,
    over the whole span of the table."""
    t = tables(spark, sf_dir)
    e = t.events
    counts = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n_events"))
    keys = e.select("user_id").distinct()
    lo = e.select(F.min(F.to_date("ts"))).scalar()
    hi = e.select(F.max(F.to_date("ts"))).scalar()
    out = ts_ops.calendar_fill(counts, keys, "day", lo, hi, {"n_events": 0})
    return out.select("user_id", "day", F.col("n_events").cast("long").alias("n_events"))


@register("order_calendar", sql="""
SELECT o_orderkey,
       CAST(year(o_orderdate) AS BIGINT) AS year, CAST(quarter(o_orderdate) AS BIGINT) AS quarter,
       CAST(weekofyear(o_orderdate) AS BIGINT) AS iso_week, CAST(isodow(o_orderdate) AS BIGINT) AS iso_dow,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS age_days
FROM orders
""")
def order_calendar(spark, sf_dir):
    """P48 calendar_features on order dates."""
    t = tables(spark, sf_dir)
    out = ts_ops.calendar_features(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate",
                                   "2002-01-01")
    return out.drop("o_orderdate")
