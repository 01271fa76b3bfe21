"""Session construction and the shared scratch area.

On a cluster the scratch area is the shared folder named by
``spark.checkpoint.dir``; it is only set here when the session has none
(local runs and tests), and then to a fresh ``mktemp``-style folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tessera") -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    memory = os.environ.get("TESSERA_DRIVER_MEMORY", "8g" if (master or "").startswith("local") else None)
    if memory:  # in local mode the driver is the executor too; elsewhere the caller's setting stands
        builder = builder.config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; created under /tmp only when unset and
    driver and executors are one process. On a cluster it must be set: each
    machine would write to a /tmp of its own."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever file system Spark finds it; errors are raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df):
    """Cut the lineage of ``df``: an eager, reliable checkpoint written to the
    shared checkpoint folder (never a local checkpoint), so a lost executor
    costs a re-read instead of recomputing every earlier stage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def persist_table(df, name: str = "table", packed: bool = False):
    """Write ``df`` as parquet to a fresh folder under the shared checkpoint
    folder and return the table read back: computed exactly once, columnar,
    and independent of the lineage that produced it. What is ``packed``, that
    is holds compressed bytes, is not compressed again: Parquet's codecs keep
    buffers as large as the values outside the heap."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.option("compression", "uncompressed") if packed else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
