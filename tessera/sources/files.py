"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
# Text formats keep full microsecond precision (Spark's default drops to ms).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_TS_OPTS = {"timestampNTZFormat": TS_FORMAT, "timestampFormat": TS_FORMAT + "XXX"}


def read_delimited(spark: SparkSession, path: str, schema: T.StructType,
                   header: bool = True, sep: str = ",") -> DataFrame:
    """CSV with a declared schema. Rows that do not parse are kept, with their raw
    text in ``_corrupt_record`` and the typed columns null (PERMISSIVE mode);
    split them off with ``bad_rows`` / ``good_rows``."""
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)])
    return (spark.read.schema(full)
            .option("header", header).option("sep", sep)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .options(**_TS_OPTS)
            .csv(path))


def write_delimited(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> str:
    df.write.option("header", header).option("sep", sep).options(**_TS_OPTS).csv(path)
    return path


def _all_read(df: DataFrame):
    """True for every row; it needs all columns. The CSV reader converts only the
    columns that a plan needs, and a row is bad if any of them does not convert."""
    return F.hash(*[c for c in df.columns if c != CORRUPT]) >= F.lit(-(1 << 31))


def bad_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNotNull() & _all_read(df))


def good_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNull() & _all_read(df)).drop(CORRUPT)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema (no inference pass over the data)."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").options(**_TS_OPTS).json(path)


def write_json_lines(df: DataFrame, path: str) -> str:
    df.write.options(**_TS_OPTS).json(path)
    return path


def write_partitioned(df: DataFrame, path: str, cols: list[str], fmt: str = "parquet") -> str:
    """Write ``df`` partitioned by ``cols``. Rows are brought together by the partition
    columns (``rebalance``), so each task writes few directories; adaptive execution
    then splits a value that holds many rows over several tasks and files of about
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, and lets small ones share a task."""
    df.hint("rebalance", *cols).write.mode("overwrite").partitionBy(*cols).format(fmt).save(path)
    return path
