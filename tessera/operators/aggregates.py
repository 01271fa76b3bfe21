"""Aggregation, reshaping, ranking and set operators.

All aggregates here are hash aggregates with a partial (map-side) step, so a
hot group is reduced inside every map task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGGS = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count,
    "var": F.var_samp, "stddev": F.stddev_samp, "median": F.median,
}


def summarise(df: DataFrame, by: Sequence[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """``aggs`` maps output name -> (function, column); functions as in ``_AGGS``."""
    return df.groupBy(*by).agg(*[_AGGS[f](c).alias(n) for n, (f, c) in aggs.items()])


def subtotals(df: DataFrame, levels: Sequence[str], aggs: Sequence[Column],
              level_name: str = "level") -> DataFrame:
    """Subtotals along a hierarchy (``rollup``); ``level`` is ``grouping_id()``:
    0 for detail rows, growing as levels are rolled up."""
    return df.rollup(*levels).agg(*aggs, F.grouping_id().alias(level_name))


def crosstab(df: DataFrame, a: str, b: str, name: str = "n") -> DataFrame:
    """Contingency counts with margins and grand total (``cube``). Rows are
    first counted per cell, so the cube's Expand multiplies cells, not rows."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("_c"))
    return cells.cube(a, b).agg(F.sum("_c").cast("long").alias(name), F.grouping_id().alias("level"))


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggs: Sequence[Column]) -> DataFrame:
    """Only the chosen grouping sets, in one aggregate (one Expand, one shuffle)."""
    cols = sorted({c for s in sets for c in s})
    return (df.groupingSets([[F.col(c) for c in s] for s in sets], *cols)
              .agg(*aggs, F.grouping_id().alias("level")))


def distinct_counts(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Exact distinct counts per group (``count_distinct``)."""
    return df.groupBy(*by).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in cols])


def distinct_counts_approx(df: DataFrame, by: Sequence[str], cols: Sequence[str],
                           rsd: float = 0.02, lg_k: int = 12) -> DataFrame:
    """Sketched distinct counts: HyperLogLog++ (``approx_count_distinct``) and
    the mergeable Datasketches HLL (``hll_sketch_agg``), whose binary sketch can
    be stored and unioned later. Memory per group is fixed by ``rsd``/``lg_k``."""
    out = []
    for c in cols:
        out.append(F.approx_count_distinct(c, rsd).alias(f"approx_{c}"))
        out.append(F.hll_sketch_estimate(F.hll_sketch_agg(c, lg_k)).alias(f"hll_{c}"))
    return df.groupBy(*by).agg(*out)


def pivot_counts(df: DataFrame, by: Sequence[str], col: str, values: Sequence[str]) -> DataFrame:
    """Wide table of row counts, one column per listed value (0 when absent).
    Listing the values up front saves the extra job that finds them."""
    p = df.groupBy(*by).pivot(col, list(values)).count()
    return p.select(*by, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("long").alias(str(v))
                           for v in values])


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "attribute",
            value: str = "value") -> DataFrame:
    """Wide to long (``unpivot``); the value columns must share a type."""
    return df.unpivot(list(ids), list(cols), name, value)


def relate(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation, least-squares slope / intercept and covariance."""
    return df.groupBy(*by).agg(
        F.corr(x, y).alias("corr"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.covar_samp(x, y).alias("covar"),
        F.regr_r2(y, x).alias("r2"),
        F.count(F.lit(1)).alias("n"))


def top_n_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The n first rows of each group under ``order`` (make it total for a
    deterministic result). ``row_number() <= n`` is planned as a window group
    limit, which keeps only n rows per group inside each map task before the
    shuffle, so a hot group costs no more than any other."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """k first rows overall: ``orderBy().limit()`` is planned as
    TakeOrderedAndProject (per-task top-k, then a k-row merge)."""
    return df.orderBy(*order).limit(k)


def stack(*dfs: DataFrame) -> DataFrame:
    """Union by column name; a column missing from a part is null there."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def common(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    """Rows in both: set (``intersect``) or multiset (``intersectAll``)."""
    return a.intersectAll(b) if all else a.intersect(b)


def difference(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    """Rows of ``a`` not in ``b``: set (``subtract``) or multiset (``exceptAll``)."""
    return a.exceptAll(b) if all else a.subtract(b)
