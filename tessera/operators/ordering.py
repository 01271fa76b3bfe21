"""Ordered positions without one-task windows (H11), and what builds on them.

A window with no ``partitionBy`` (or a group that holds a third of the rows)
runs in one task. ``with_positions`` instead range-partitions on
(group, order) with Spark's range partitioner, numbers rows inside each range
partition, and adds the row counts of the earlier partitions of the same group.

The partition id and in-partition sequence number are written once, with the
rows, to a parquet table in the shared checkpoint folder (``persist_table``)
and read back. Every later branch of the plan reads the same assignment, so
the result cannot depend on a range exchange being evaluated twice with
different samples; the write also cuts the lineage for executor loss.

Plan: sampling job + range exchange → local sort → write; read → partial
aggregate of counts per (partition, group) → prefix sums over that small
table → join back. Running sums add one hash exchange on (partition, group)
before the write, which keeps each range partition whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import persist_table


def _spec(o: str) -> tuple[str, bool]:
    """``"col"`` ascending (nulls first), ``"-col"`` descending (nulls last)."""
    return (o[1:], False) if o.startswith("-") else (o, True)


def _order_cols(specs) -> list[Column]:
    return [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in specs]


def _partitions(df: DataFrame, n: int | None) -> int:
    return n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, keys: Sequence[str], partitions: int | None = None,
           running: str | None = None, within: Sequence[str] = ()) -> DataFrame:
    """``df`` range-partitioned and sorted on ``keys`` (see ``_spec``), with
    ``_pid`` (range partition) and ``_mid`` (increasing inside a partition in
    sort order), persisted once. With ``running`` also ``_lcum``: the running
    sum of that column inside each (partition, ``within``) group."""
    cols = _order_cols([_spec(k) for k in keys])
    r = (df.repartitionByRange(_partitions(df, partitions), *cols)
           .sortWithinPartitions(*cols)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id()))
    if running:
        w = (Window.partitionBy("_pid", *within).orderBy("_mid")
             .rowsBetween(Window.unboundedPreceding, 0))
        r = r.withColumn("_lcum", F.sum(running).over(w))
    return persist_table(r, "ranged")


def with_positions(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), *,
                   running: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``_pos`` (1-based position within the ``by`` group under ``order``)
    and ``_n`` (group size). ``order`` lists columns, ``-`` for descending; it
    must be a total order within a group (end it with a unique key). With
    ``running=col`` also add ``_cum`` (inclusive running sum of ``col``; null
    until the first non-null value, as in SQL) and ``_tot`` (group total)."""
    by = list(by)
    m = ranged(df, [*by, *order], partitions, running, by)
    aggs = [F.min("_mid").alias("_mid0"), F.count(F.lit(1)).alias("_cnt")]
    if running:
        aggs.append(F.sum(running).alias("_psum"))
    stats = m.groupBy("_pid", *by).agg(*aggs)
    w_prev = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*by)
    stats = (stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(w_prev), F.lit(0)))
                  .withColumn("_n", F.sum("_cnt").over(w_all)))
    if running:
        stats = (stats.withColumn("_coff", F.sum("_psum").over(w_prev))
                      .withColumn("_tot", F.sum("_psum").over(w_all)))
    keys = ["_pid", *by]
    stats = stats.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_mid0", "_off", "_n",
                         *(["_coff", "_tot"] if running else []))
    # Without groups the table has one row per range partition: a proven bound.
    # With groups it has about one row per group; adaptive execution measures
    # it once materialized and broadcasts it only when small.
    if not by:
        stats = F.broadcast(stats)
    # the partition id is never null; group keys may be, so they match null-safe
    cond = [F.col("_pid") == F.col("_k0")] + [F.col(c).eqNullSafe(F.col(f"_k{i}"))
                                               for i, c in enumerate(keys) if i > 0]
    out = m.join(stats, cond, "inner").drop(*[f"_k{i}" for i in range(len(keys))])
    out = out.withColumn("_pos", F.col("_off") + (F.col("_mid") - F.col("_mid0")) + 1)
    if running:
        cum = F.when(F.col("_coff").isNull() & F.col("_lcum").isNull(), F.lit(None)).otherwise(
            F.coalesce(F.col("_coff"), F.lit(0)) + F.coalesce(F.col("_lcum"), F.lit(0)))
        out = out.withColumn("_cum", cum).drop("_coff", "_lcum")
    return out.drop("_pid", "_mid", "_mid0", "_off")


def ntile_of(pos: Column, n: Column, k: int) -> Column:
    """ntile(k) from a 1-based position and the group size (SQL semantics: the
    first ``n % k`` tiles hold one row more)."""
    size = F.floor(n / k).cast("long")
    rem = (n % k).cast("long")
    big = rem * (size + 1)
    return (F.when(pos <= big, F.floor((pos - 1) / (size + 1)) + 1)
             .otherwise(rem + F.floor((pos - 1 - big) / size) + 1)).cast("long")


def ntile(df: DataFrame, k: int, order: Sequence[str], by: Sequence[str] = (), name: str = "ntile",
          partitions: int | None = None) -> DataFrame:
    """``ntile(k) over (partition by by order by order)`` without a one-task window."""
    p = with_positions(df, order, by, partitions=partitions)
    return p.withColumn(name, ntile_of(F.col("_pos"), F.col("_n"), k)).drop("_pos", "_n")


def value_histogram(df: DataFrame, value: str, by: Sequence[str] = (),
                    partitions: int | None = None) -> DataFrame:
    """Distinct values per group with their count (``_cnt``), position among
    the distinct values (``_pos``, the dense rank), running count through the
    value (``_cum``) and the group's row count (``_tot``). Equal values
    collapse in a partial aggregate first, so a hot value costs one row."""
    by = list(by)
    h = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_cnt"))
    return with_positions(h, [value], by, running="_cnt", partitions=partitions).drop("_n")


def rank_all(df: DataFrame, by: Sequence[str], value: str, tiebreak: Sequence[str] = (),
             partitions: int | None = None) -> DataFrame:
    """rank, dense_rank, percent_rank and cume_dist of ``value`` (ascending,
    nulls first) within ``by``, as SQL defines them. Built from the value
    histogram and joined back on (group, value), null-safe; ``tiebreak`` is
    not needed (ties share a rank) and kept for compatibility."""
    by = list(by)
    h = value_histogram(df, value, by, partitions=partitions)
    ranks = (h.withColumn("rnk", F.col("_cum") - F.col("_cnt") + 1)
              .withColumn("drnk", F.col("_pos"))
              .withColumn("prank", F.when(F.col("_tot") > 1, (F.col("rnk") - 1) / (F.col("_tot") - 1))
                          .otherwise(F.lit(0.0)))
              .withColumn("cdist", F.col("_cum") / F.col("_tot"))
              .select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by + [value])],
                      "rnk", "drnk", "prank", "cdist"))
    cond = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by + [value])]
    return df.join(ranks, cond, "inner").drop(*[f"_k{i}" for i in range(len(by) + 1)])


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (),
                    names: Sequence[str] | None = None, tiebreak: Sequence[str] = (),
                    partitions: int | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles (``percentile`` / ``quantile_cont``)
    per group, nulls ignored. Built from the value histogram: the value at
    1-based position p is the distinct value whose running count first reaches
    p, so only distinct values are ordered and no group is buffered whole.
    ``tiebreak`` is not needed and kept for compatibility."""
    by = list(by)
    names = list(names or [f"q{int(round(q * 100))}" for q in qs])
    h = value_histogram(df.where(F.col(value).isNotNull()), value, by, partitions=partitions)
    first = F.col("_cum") - F.col("_cnt") + 1          # first position held by the value
    aggs = []
    for q, nm in zip(qs, names):
        hpos = (F.col("_tot") - 1) * F.lit(float(q))   # 0-based fractional position
        lo, hi = F.floor(hpos) + 1, F.ceil(hpos) + 1
        frac = hpos - F.floor(hpos)
        v_lo = F.max(F.when((first <= lo) & (F.col("_cum") >= lo), F.col(value)))
        v_hi = F.max(F.when((first <= hi) & (F.col("_cum") >= hi), F.col(value)))
        aggs.append((v_lo + F.max(frac) * (v_hi - v_lo)).alias(nm))
    return h.groupBy(*by).agg(*aggs)
