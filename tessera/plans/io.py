"""Jobs: file sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import money
from tessera.plans.registry import register, tables
from tessera.session import scratch_path
from tessera.sources import files
from tessera.sources.tables import SCHEMAS

_ORDERS_CSV_SCHEMA = T.StructType([f for f in SCHEMAS["orders"].fields])


@register("orders_csv_bad_rows", sql="""
SELECT o_orderkey, o_orderstatus, o_orderdate,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice,
       o_orderstatus = 'P' AS is_bad
FROM orders
""")
def orders_csv_bad_rows(spark, sf_dir):
    """P02 read_delimited: orders exported as CSV where pending orders carry a
    currency-formatted price; those rows are kept, flagged, with a null price."""
    t = tables(spark, sf_dir)
    o = t.orders
    price = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("$"), F.col("o_totalprice").cast("string"))) \
             .otherwise(F.col("o_totalprice").cast("string"))
    path = scratch_path(spark, "orders-csv")
    files.write_delimited(o.withColumn("o_totalprice", price), path)
    back = files.read_delimited(spark, path, _ORDERS_CSV_SCHEMA)
    return back.select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice",
                       F.col(files.CORRUPT).isNotNull().alias("is_bad"))


@register("events_json_roundtrip", sql="SELECT * FROM events")
def events_json_roundtrip(spark, sf_dir):
    """P03 read_json_lines: events written as JSON lines and read back with the
    declared schema."""
    t = tables(spark, sf_dir)
    path = scratch_path(spark, "events-json")
    files.write_json_lines(t.events, path)
    return files.read_json_lines(spark, path, SCHEMAS["events"])


@register("orders_by_year_partitioned", sql=f"""
SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, count(*) AS n_orders,
       CAST(sum({money.price_sql("o_totalprice")}) AS DOUBLE) AS revenue
FROM orders GROUP BY 1
""")
def orders_by_year_partitioned(spark, sf_dir):
    """P04 write_partitioned: orders written partitioned by year, read back
    (per-year totals come from the partition column)."""
    t = tables(spark, sf_dir)
    path = scratch_path(spark, "orders-by-year")
    files.write_partitioned(t.orders.withColumn("o_year", F.year("o_orderdate")), path, ["o_year"])
    back = spark.read.parquet(path)
    return back.groupBy(F.col("o_year").cast("long").alias("o_year")).agg(
        F.count(F.lit(1)).alias("n_orders"), money.total(money.price("o_totalprice")).alias("revenue"))


@register("table_row_counts", sql="\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST({len(SCHEMAS[t].fields)} AS BIGINT) AS n_columns "
    f"FROM {t}" for t in SCHEMAS))
def table_row_counts(spark, sf_dir):
    """P01 load_table over every fixture table: rows and declared columns per
    table (a count over each scan; no column is read)."""
    from tessera.sources.tables import load_table
    tables(spark, sf_dir)
    parts = [load_table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(t).alias("table_name"), "n_rows",
                     F.lit(len(SCHEMAS[t].fields)).cast("long").alias("n_columns"))
             for t in SCHEMAS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
