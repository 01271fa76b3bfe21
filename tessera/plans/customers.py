"""Jobs: cohorts, retention, funnel, sessions, active users, LTV, RFM, ABC, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import money
from tessera.operators import customers as cu
from tessera.plans.registry import register, tables


@register("order_cohort_retention", sql="""
WITH up AS (SELECT DISTINCT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period
            FROM orders),
     c AS (SELECT period, min(period) OVER (PARTITION BY o_custkey) AS cohort FROM up),
     p AS (SELECT cohort,
                  CAST((year(period) * 4 + quarter(period)) - (year(cohort) * 4 + quarter(cohort)) AS BIGINT)
                    AS period_n,
                  count(*) AS n_active
           FROM c GROUP BY 1, 2)
SELECT cohort, period_n, n_active,
       max(CASE WHEN period_n = 0 THEN n_active END) OVER (PARTITION BY cohort) AS cohort_size,
       n_active / max(CASE WHEN period_n = 0 THEN n_active END) OVER (PARTITION BY cohort) AS retention
FROM p
""")
def order_cohort_retention(spark, sf_dir):
    """P52 cohort_retention: customers by first-order quarter and quarters since."""
    t = tables(spark, sf_dir)
    out = cu.cohort_retention(t.orders, "o_custkey", "o_orderdate", "quarter")
    return out


@register("event_day_n_retention", sql="""
WITH up AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events),
     c AS (SELECT user_id, d, min(d) OVER (PARTITION BY user_id) AS first_d FROM up),
     p AS (SELECT CAST(date_diff('day', first_d, d) AS BIGINT) AS day_n, count(*) AS n_users
           FROM c GROUP BY 1)
SELECT day_n, n_users,
       n_users / max(CASE WHEN day_n = 0 THEN n_users END) OVER () AS rate
FROM p
""")
def event_day_n_retention(spark, sf_dir):
    """P53 day_n_retention: share of users active n days after their first day."""
    t = tables(spark, sf_dir)
    return cu.day_n_retention(t.events, "user_id", "ts")


FUNNEL_STEPS = ["signup", "view", "click", "purchase"]


def _funnel_sql(steps, hours):
    ctes = [f"s1 AS (SELECT user_id, min(ts) AS t1, min(ts) AS tk FROM events "
            f"WHERE event_type = '{steps[0]}' GROUP BY 1)"]
    for i, s in enumerate(steps[1:], start=2):
        ctes.append(
            f"s{i} AS (SELECT p.user_id, p.t1, min(e.ts) AS tk FROM s{i - 1} p JOIN events e "
            f"ON e.user_id = p.user_id AND e.event_type = '{s}' AND e.ts > p.tk "
            f"AND e.ts <= p.t1 + INTERVAL {hours} HOUR GROUP BY 1, 2)")
    sel = " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS step, '{s}' AS step_name, count(*) AS n_users FROM s{i}"
        for i, s in enumerate(steps, start=1))
    return "WITH " + ",\n".join(ctes) + "\n" + sel


@register("event_funnel_48h", sql=_funnel_sql(FUNNEL_STEPS, 48))
def event_funnel_48h(spark, sf_dir):
    """P54 funnel: signup -> view -> click -> purchase within 48 h of signup."""
    t = tables(spark, sf_dir)
    e = t.events.select("user_id", "ts", "event_type")
    return cu.funnel(e, "user_id", "ts", "event_type", FUNNEL_STEPS, "48 hours")


@register("user_sessions_24h", sql="""
WITH x AS (SELECT user_id, ts, event_id,
                  lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
     y AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 24 HOUR THEN 1 ELSE 0 END)
                     OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid
           FROM x)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_last, count(*) AS n_events,
       CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS BIGINT) AS duration_s
FROM y GROUP BY user_id, sid
""")
def user_sessions_24h(spark, sf_dir):
    """P55 sessions: 24 h inactivity gap (a 30 min gap splits almost every event
    of this fixture into its own session)."""
    t = tables(spark, sf_dir)
    return cu.sessions(t.events, "user_id", "ts", "24 hours", tiebreak=["event_id"])


@register("active_users", sql="""
WITH ud AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events)
SELECT 'day' AS grain, d AS period_start, count(*) AS active_users FROM ud GROUP BY d
UNION ALL
SELECT 'week', CAST(date_trunc('week', d) AS DATE), count(DISTINCT user_id) FROM ud GROUP BY 2
UNION ALL
SELECT 'month', CAST(date_trunc('month', d) AS DATE), count(DISTINCT user_id) FROM ud GROUP BY 2
""")
def active_users(spark, sf_dir):
    """P56 active_users: DAU, WAU (ISO weeks) and MAU."""
    t = tables(spark, sf_dir)
    return cu.active_users(t.events, "user_id", "ts")


@register("monthly_stickiness", sql="""
WITH ud AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events),
     dau AS (SELECT CAST(date_trunc('month', d) AS DATE) AS month, avg(n) AS avg_dau
             FROM (SELECT d, count(*) AS n FROM ud GROUP BY d) GROUP BY 1),
     mau AS (SELECT CAST(date_trunc('month', d) AS DATE) AS month, count(DISTINCT user_id) AS mau
             FROM ud GROUP BY 1)
SELECT month, round(avg_dau, 6) AS avg_dau, mau, round(avg_dau / mau, 8) AS stickiness
FROM dau JOIN mau USING (month)
""")
def monthly_stickiness(spark, sf_dir):
    """P56 stickiness: mean DAU over MAU per month."""
    t = tables(spark, sf_dir)
    s = cu.stickiness(t.events, "user_id", "ts")
    return s.select("month", F.round("avg_dau", 6).alias("avg_dau"), "mau",
                    F.round("stickiness", 8).alias("stickiness"))


@register("order_ltv_quarterly", sql=f"""
WITH up AS (SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period,
                   sum({money.price_sql("o_totalprice")}) AS amount
            FROM orders GROUP BY 1, 2),
     c AS (SELECT period, amount, min(period) OVER (PARTITION BY o_custkey) AS cohort FROM up),
     p AS (SELECT cohort,
                  CAST((year(period) * 4 + quarter(period)) - (year(cohort) * 4 + quarter(cohort)) AS BIGINT)
                    AS period_n,
                  sum(amount) AS revenue, count(*) AS n_active
           FROM c GROUP BY 1, 2),
     q AS (SELECT *, max(CASE WHEN period_n = 0 THEN n_active END) OVER (PARTITION BY cohort) AS cohort_size,
                  sum(revenue) OVER (PARTITION BY cohort ORDER BY period_n ROWS UNBOUNDED PRECEDING)
                    AS cum_revenue
           FROM p)
SELECT cohort, period_n, CAST(revenue AS DOUBLE) AS revenue, n_active, cohort_size,
       CAST(cum_revenue AS DOUBLE) AS cum_revenue, CAST(cum_revenue AS DOUBLE) / cohort_size AS ltv
FROM q
""")
def order_ltv_quarterly(spark, sf_dir):
    """P57 ltv: cumulative revenue per cohort member by quarter."""
    t = tables(spark, sf_dir)
    o = t.orders.withColumn("amount", money.price("o_totalprice"))
    out = cu.ltv(o, "o_custkey", "o_orderdate", "amount", "quarter")
    return out.select("cohort", "period_n", F.col("revenue").cast("double").alias("revenue"), "n_active",
                      "cohort_size", F.col("cum_revenue").cast("double").alias("cum_revenue"),
                      (F.col("cum_revenue").cast("double") / F.col("cohort_size")).alias("ltv"))


@register("customer_rfm", sql=f"""
WITH per AS (
  SELECT o_custkey,
         CAST(date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-09-01') AS BIGINT) AS recency_days,
         count(*) AS frequency, CAST(sum({money.price_sql("o_totalprice")}) AS DOUBLE) AS monetary
  FROM orders GROUP BY 1)
SELECT *, ntile(5) OVER (ORDER BY recency_days DESC, o_custkey) AS r_score,
          ntile(5) OVER (ORDER BY frequency, o_custkey) AS f_score,
          ntile(5) OVER (ORDER BY monetary, o_custkey) AS m_score
FROM per
""")
def customer_rfm(spark, sf_dir):
    """P58 rfm: recency / frequency / money quintiles over all customers."""
    t = tables(spark, sf_dir)
    o = t.orders.withColumn("amount", money.price("o_totalprice"))
    return cu.rfm(o, "o_custkey", "o_orderdate", "amount", "2001-09-01")


@register("part_abc", sql=f"""
WITH per AS (SELECT l_partkey, sum({money.NET_SQL}) AS amount FROM lineitem GROUP BY 1),
     r AS (SELECT *, row_number() OVER (ORDER BY amount DESC, l_partkey) AS rank,
                  CAST(sum(amount) OVER (ORDER BY amount DESC, l_partkey ROWS UNBOUNDED PRECEDING) AS DOUBLE)
                  / CAST(sum(amount) OVER () AS DOUBLE) AS cum_share
           FROM per)
SELECT l_partkey, CAST(amount AS DOUBLE) AS amount, rank, cum_share,
       CASE WHEN cum_share <= 0.8 THEN 'A' WHEN cum_share <= 0.95 THEN 'B' ELSE 'C' END AS class
FROM r
""")
def part_abc(spark, sf_dir):
    """P59 abc: parts by share of cumulative net revenue."""
    t = tables(spark, sf_dir)
    li = t.lineitem.select("l_partkey", money.net().alias("net"))
    return cu.abc(li, "l_partkey", "net").withColumn("amount", F.col("amount").cast("double"))


@register("user_first_last_touch", sql="""
SELECT user_id, arg_min(event_type, ts) AS first_event_type, arg_max(event_type, ts) AS last_event_type,
       min(ts) AS first_ts, max(ts) AS last_ts
FROM events GROUP BY user_id
""")
def user_first_last_touch(spark, sf_dir):
    """P60 first_last_touch: first and last event type per user."""
    t = tables(spark, sf_dir)
    return cu.first_last_touch(t.events, "user_id", "ts", "event_type", tiebreak=["event_id"])


def _typed(t, kind, id_name, ts_name):
    return (t.events.where(F.col("event_type") == kind)
            .select("user_id", F.col("event_id").alias(id_name), F.col("ts").alias(ts_name)))


@register("view_to_purchase_6h", sql="""
SELECT v.user_id, v.event_id AS view_id, p.event_id AS purchase_id,
       (epoch_us(p.ts) - epoch_us(v.ts)) / 1000000.0 AS lag_s
FROM events v JOIN events p
  ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase'
 AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 6 HOUR
""")
def view_to_purchase_6h(spark, sf_dir):
    """P24 interval_join: purchases within 6 h after a view by the same user,
    keyed by (user, 6 h bucket) so a heavy user is split by time."""
    from tessera.operators.joins import interval_join
    t = tables(spark, sf_dir)
    v = _typed(t, "view", "view_id", "view_ts")
    p = _typed(t, "purchase", "purchase_id", "purchase_ts")
    j = interval_join(v, p, "user_id", "view_ts", "purchase_ts", "6 hours")
    lag = (F.unix_micros(F.col("purchase_ts").cast("timestamp"))
           - F.unix_micros(F.col("view_ts").cast("timestamp"))) / 1_000_000.0
    return j.select("user_id", "view_id", "purchase_id", lag.alias("lag_s"))


@register("purchase_last_view", sql="""
SELECT p.event_id AS purchase_id, p.user_id, p.ts AS purchase_ts, v.event_id AS view_id, v.ts AS view_ts
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
  ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def purchase_last_view(spark, sf_dir):
    """P25 asof_join: for every purchase, the user's last view at or before it."""
    from tessera.operators.joins import asof_join
    t = tables(spark, sf_dir)
    p = _typed(t, "purchase", "purchase_id", "purchase_ts")
    v = _typed(t, "view", "view_id", "view_ts")
    out = asof_join(p, v, ["user_id"], "purchase_ts", "view_ts", ["view_id", "view_ts"],
                    right_tiebreak=["view_id"])
    return out.select("purchase_id", "user_id", "purchase_ts", "view_id", "view_ts")
