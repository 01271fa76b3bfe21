"""Registry of named jobs: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import load_tables
from tessera.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str) -> load_tables:
    """Tables of one scale factor. Jobs read fixture times as wall-clock
    (timestamp_ntz); the session zone is pinned to UTC so conversions to
    instants (watermarks, epoch arithmetic) are the same on every machine."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    return load_tables(spark, sf_dir)


def register(name: str, sql: str | None = None):
    """Register a job; ``sql`` is the DuckDB oracle (None: no SQL form)."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate job {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco
