"""Stored sketches of distinct values.

A sketch of a set has a fixed size, whatever the set; sketches of parts merge into
that of the whole. So the events of a day are read once, its sketches kept as a
table of one row per day (and group), and weeks, months or any other union come
from that table alone. Two kinds:

* HyperLogLog for counts of unions, at most about ``2 ** lg_k`` bytes each;
* theta sketches for counts of intersections and differences as well, at most
  ``8 * 2 ** lg_k`` bytes each, exact up to ``2 ** lg_k`` values.

Nulls are no values. A group without a value has a sketch that estimates 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import persist_table


def count_sketches(df: DataFrame, by: Sequence[str | Column], cols: Sequence[str], lg_k: int = 12, store: str | None = None) -> DataFrame:
    """``sk_<col>`` for every group, reduced in each task before the shuffle. With ``store`` written once as a table."""
    out = df.groupBy(*by).agg(*[F.hll_sketch_agg(c, lg_k).alias(f"sk_{c}") for c in cols])
    return persist_table(out, store) if store else out


def merge_sketches(sketches: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones; the rows sketched are not read again."""
    named = [c for c in sketches.columns if c.startswith("sk_")]
    return sketches.groupBy(*by).agg(*[F.hll_union_agg(c).alias(c) for c in named])


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """``approx_<col>`` in place of ``sk_<col>``."""
    return sketches.select(*[F.hll_sketch_estimate(c).alias(f"approx_{c[3:]}") if c.startswith("sk_") else F.col(c) for c in sketches.columns])


def within_error(estimate: Column, true: Column, lg_k: int = 12, sigmas: float = 4.0) -> Column:
    """Whether a merged sketch's estimate lies within that many of its standard errors (1.04 / sqrt(2 ** lg_k)) of the truth, or one."""
    return F.abs(estimate - true) <= F.greatest(F.lit(1.0), F.lit(sigmas * 1.04 / 2 ** (lg_k / 2)) * true)


def set_sketches(df: DataFrame, by: Sequence[str | Column], col: str, lg_k: int = 12, store: str | None = None) -> DataFrame:
    """Theta sketch ``set`` of the values of ``col`` for every group."""
    out = df.groupBy(*by).agg(F.theta_sketch_agg(col, lg_k).alias("set"))
    return persist_table(out, store) if store else out


def overlaps(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """For pairs of sets (``left`` and ``right`` with columns of different names but ``set``, small tables of one row
    for each set): approx_both, approx_left_only and approx_union."""
    a, b = left.withColumnRenamed("set", "_a"), right.withColumnRenamed("set", "_b")
    pairs = a.join(b, on)
    return pairs.select(*[c for c in pairs.columns if c not in ("_a", "_b")],
                        F.theta_sketch_estimate(F.theta_intersection("_a", "_b")).alias("approx_both"),
                        F.theta_sketch_estimate(F.theta_difference("_a", "_b")).alias("approx_left_only"),
                        F.theta_sketch_estimate(F.theta_union("_a", "_b")).alias("approx_union"))


def overlap_within_error(estimate: Column, true: Column, union: Column, lg_k: int = 12, sigmas: float = 4.0) -> Column:
    """As ``within_error`` for an intersection: its variance is about true * union / 2 ** lg_k."""
    return F.abs(estimate - true) <= F.greatest(F.lit(1.0), F.lit(sigmas / 2 ** (lg_k / 2)) * F.sqrt(true * union))
