"""File sources and sinks on hand-made files."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from support import SF_SMALL, rows
from tessera.session import scratch_path
from tessera.sources import files
from tessera.sources.tables import SCHEMAS, TABLES, load_table


def test_declared_schemas_match_files(spark):
    for t in TABLES:
        df = load_table(spark, SF_SMALL, t)
        assert df.schema == SCHEMAS[t]
        assert df.count() > 0


def test_csv_bad_rows_are_kept_apart(spark):
    path = scratch_path(spark, "t-csv")
    os.makedirs(path)
    with open(os.path.join(path, "part.csv"), "w") as f:
        f.write("id,amount\n1,2.5\n2,oops\n3,4.0\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("amount", T.DoubleType())])
    df = files.read_delimited(spark, path, schema)
    assert rows(files.good_rows(df).select("id")) == [(1,), (3,)] and rows(files.bad_rows(df).select("id")) == [(2,)]
    assert rows(files.good_rows(df)) == [(1, 2.5), (3, 4.0)]
    bad = files.bad_rows(df).collect()
    assert [(r["id"], r[files.CORRUPT]) for r in bad] == [(2, "2,oops")]


def test_json_lines_keep_microseconds(spark):
    import datetime as dt
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.TimestampNTZType())])
    src = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 0, 7, 179575))], schema)
    path = scratch_path(spark, "t-json")
    files.write_json_lines(src, path)
    assert rows(files.read_json_lines(spark, path, schema)) == rows(src)


def test_partitioned_write_prunes_partitions(spark):
    from pyspark.sql import functions as F
    df = spark.range(0, 100).withColumn("p", (F.col("id") % 4).cast("int"))
    path = scratch_path(spark, "t-part")
    files.write_partitioned(df, path, ["p"])
    back = spark.read.parquet(path).where(F.col("p") == 2)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "(p" in plan
    assert back.count() == 25


def test_partitioned_write_splits_a_hot_value(spark):
    """Several files for the value with most rows, one for the others; a null value and no rows at all."""
    from tessera.streaming.sinks import _settings

    df = spark.range(200_000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 1000 == 0, F.lit(None)).otherwise(
        (F.col("id") % 5).cast("string")).alias("p"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    path = scratch_path(spark, "t-hot")
    with _settings(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.shuffle.partitions": "64"}):
        files.write_partitioned(df, path, ["p"])
    back = spark.read.parquet(path)
    assert back.groupBy("p").count().exceptAll(df.groupBy("p").count()).isEmpty()
    n = {r.p: r["count"] for r in back.select("p", F.input_file_name().alias("f")).distinct().groupBy("p").count().collect()}
    assert n["hot"] >= 3 and all(k == "hot" or v <= 2 for k, v in n.items()) and None in n
    files.write_partitioned(df.where("false"), scratch_path(spark, "t-none"), ["p"])
