"""Stream sources."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import SCHEMAS


def file_stream(spark: SparkSession, path: str, schema: T.StructType, *, fmt: str = "parquet",
                glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream with a declared schema (a stream cannot infer one)."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def with_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP, the files hold TIMESTAMP_NTZ (wall clock);
    the cast reads the wall clock in the session zone (UTC in these jobs)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def event_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None,
                 path: str | None = None) -> DataFrame:
    """The ``events`` table as a stream, event time ``ts`` as TIMESTAMP."""
    # a pattern of one match: it takes the table as a single file and as a folder of part files
    s = file_stream(spark, path or os.path.join(sf_dir, "events.parque[t]"), SCHEMAS["events"],
                    max_files_per_trigger=max_files_per_trigger)
    return with_event_time(s)


def write_with_end_marker(df: DataFrame, ts: str, after: str, marker: dict, name: str) -> str:
    """Write a bounded table for replay, followed by one end-of-input marker row
    whose event time lies ``after`` past the table's last event. The marker
    advances the watermark far enough that every window or session of the real
    rows closes and is emitted in append mode, as a later event would do on a
    live stream. The marker's own window stays open and is never emitted.
    ``marker`` gives the values of the other columns."""
    import os

    from tessera.session import scratch_path
    root = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(os.path.join(root, "part=data"))
    last = df.agg(F.max(ts).alias(ts))
    cols = [F.lit(marker[c]).cast(df.schema[c].dataType).alias(c) if c != ts
            else (F.col(ts) + F.expr(f"INTERVAL {after}")).alias(ts) for c in df.columns]
    last.select(*cols).write.mode("overwrite").parquet(os.path.join(root, "part=end"))
    return root
