"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import persist_table, scratch_path

__all__ = ["bounded_groups", "few_at_a_time", "give_back", "kept", "let_go", "numbered", "persist_gathered", "persist_table", "read_table", "scratch_path"]

_kept: dict = {}  # name -> (stage, value), in each worker


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one input table, by a path that only Spark needs to read."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def persist_gathered(df: DataFrame, name: str, by: str) -> DataFrame:
    """Like ``persist_table``, for few rows from many tasks: a shuffle by ``by`` gathers them into files of Spark's
    advisory size. Where Hadoop's native library is missing it starts a ``chmod`` for every file that it creates on a
    local file system, and until that runs its own program its memory is the executor's, counted a second time."""
    return persist_table(df.hint("rebalance", by), name)


def give_back() -> None:
    """Hands memory that this worker no longer uses back to the machine: workers go on from stage to stage,
    and what an earlier one has freed would still count as theirs."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def _stage() -> int | None:
    from pyspark import TaskContext

    task = TaskContext.get()
    return task.stageId() if task else None


def kept(name: tuple, make: Callable):
    """What ``make()`` gives, made once by a worker for all its tasks of a stage."""
    let_go()
    if name not in _kept:
        _kept[name] = (_stage(), make())
    return _kept[name][1]


def let_go() -> None:
    """Drops what earlier stages kept: a tokenizer with its cache of pieces would stay with a worker through
    all the stages that follow. Every task calls it before its own work."""
    stage = _stage()
    gone = [name for name, (of, _) in _kept.items() if of != stage]
    for name in gone:
        del _kept[name]
    if gone:
        give_back()


def few_at_a_time(batches, rows: int = 500):
    """Arrow batches cut into smaller ones, so that few texts are Python objects at a time."""
    let_go()
    for whole in batches:
        for lo in range(0, whole.num_rows, rows):
            yield whole.slice(lo, rows)
    give_back()


def bounded_groups(rows: int, most: int) -> int:
    """How many hash groups keep each near ``most`` rows, whatever the size of the input."""
    return max(1, math.ceil(rows / most))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, most: int = 100_000) -> DataFrame:
    """Gapless numbers from 0 within ``by``, without one task per group.

    Rows of a group are spread over hash buckets of about ``most`` rows in all,
    numbered there in ``order`` and shifted by the rows of the buckets before,
    so a group may hold any share of the rows. ``df`` is evaluated twice and
    must be cheap and stable: pass a written table. Rows equal in ``order`` are
    numbered in no particular order. Null keys form groups of their own.
    """
    n = bounded_groups(df.count(), most)
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = spread.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_b"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same: Column = F.col("_bucket") == F.col("_b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    rank = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)) - 1
    joined = spread.withColumn("_rank", rank).join(starts, same)
    return joined.withColumn(name, F.col("_start") + F.col("_rank")).drop(
        "_bucket", "_b", "_start", "_rank", *[f"_by_{c}" for c in by])
