"""The runners that drive a stream to completion.

``run_append`` uses the parquet file sink (exactly-once through its commit
log). ``run_changelog`` writes each micro-batch of an update-mode stream,
tagged with its batch id, to parquet (``foreachBatch``; a replayed batch
overwrites its own folder, so retries are idempotent); ``latest_by_key``
turns the changelog into the final table. Checkpoints live under the shared
checkpoint folder so a restarted driver resumes where it stopped.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.cleaning import dedupe_latest
from tessera.session import path_exists, scratch_path


def _finish(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings for the time of a run."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_append(stream: DataFrame, name: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Run an append-mode stream over everything available; return its output. ``conf`` holds for the run alone."""
    spark = stream.sparkSession
    root = scratch_path(spark, name)
    out, ckpt = os.path.join(root, "out"), os.path.join(root, "checkpoint")
    with _settings(spark, conf or {}):
        _finish(stream.writeStream.format("parquet").outputMode("append")
                .option("checkpointLocation", ckpt).trigger(availableNow=True).start(out))
    return spark.read.schema(stream.schema).parquet(out)


def run_changelog(stream: DataFrame, name: str, output_mode: str = "update",
                  root: str | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """Run a stream (update / append mode) over everything available, keeping
    every emitted row with its ``_batch`` id. With the ``root`` of an earlier
    run it goes on from that run's checkpoint and adds to its changelog.
    ``conf`` holds for the run alone."""
    spark = stream.sparkSession
    root = root or scratch_path(spark, name)
    out, ckpt = os.path.join(root, "changelog"), os.path.join(root, "checkpoint")

    def write(batch: DataFrame, batch_id: int):
        (batch.withColumn("_batch", F.lit(batch_id).cast("long"))
              .write.mode("overwrite").parquet(os.path.join(out, f"_b={batch_id}")))

    with _settings(spark, conf or {}):
        _finish(stream.writeStream.foreachBatch(write).outputMode(output_mode)
                .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    schema = T.StructType(stream.schema.fields + [T.StructField("_batch", T.LongType())])
    if not path_exists(spark, out):  # no batch produced output: empty result of the right shape
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out).drop("_b")


def latest_by_key(changelog: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final value per key from an update-mode changelog (latest batch wins)."""
    return dedupe_latest(changelog, keys, ["_batch"]).drop("_batch")
