"""Profiling and cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ordering import exact_quantiles
from tessera.operators.sizing import attach_statistics


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def profile(df: DataFrame, cols: Sequence[str] | None = None, exact_distinct: bool = True, tracked: int = 10_000) -> DataFrame:
    """One row per column, all from one aggregate pass, by the column's type.

    All: column_name, kind, n_rows, n_nulls, n_distinct, and the most frequent value with its
    count (top_value as text, top_count; a sketch that tracks ``tracked`` values, exact
    where a column has no more). Numbers: min_value, max_value, mean, and median from a
    quantile sketch (its rank is within about 1.7 %). Text: min_text, max_text, min_length,
    max_length. Dates and times: min_text and max_text. Flags: mean, the share of true.
    What does not apply is null. ``exact_distinct=False`` sketches distinct counts too,
    so every state has a fixed size. Columns of other types have counts alone."""
    cols = list(cols or df.columns)
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    nothing = {"min_value": "double", "max_value": "double", "mean": "double", "median": "double", "min_text": "string", "max_text": "string",
               "min_length": "bigint", "max_length": "bigint", "top_value": "string", "top_count": "bigint"}
    for i, c in enumerate(cols):
        kind, col = df.schema[c].dataType, F.col(f"`{c}`")
        out: dict[str, Column] = {}
        if isinstance(kind, _NUMBERS):
            name, x = "number", col.cast("double")
            out = {"min_value": F.min(x), "max_value": F.max(x), "mean": F.avg(x),
                   "median": F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(x), F.lit(0.5))}
        elif isinstance(kind, T.StringType):
            name, n = "text", F.length(col).cast("long")
            out = {"min_text": F.min(col), "max_text": F.max(col), "min_length": F.min(n), "max_length": F.max(n)}
        elif isinstance(kind, _TIMES):
            name = "time"
            out = {"min_text": F.min(col).cast("string"), "max_text": F.max(col).cast("string")}
        elif isinstance(kind, T.BooleanType):
            name, out = "flag", {"mean": F.avg(col.cast("double"))}
        else:
            name = "other"
        if name != "other":
            top = F.call_function("approx_top_k", col, F.lit(1), F.lit(tracked))
            out |= {"top_value": F.get(top, F.lit(0))["item"].cast("string"), "top_count": F.get(top, F.lit(0))["count"]}
        distinct = F.count_distinct(col) if exact_distinct else F.approx_count_distinct(col)
        if isinstance(kind, T.MapType):
            distinct = F.lit(None)
        aggs += [F.count(col).alias(f"_n{i}"), distinct.cast("long").alias(f"_d{i}"), *[v.alias(f"_{k}{i}") for k, v in out.items()]]
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(name).alias("kind"), F.col("_rows").alias("n_rows"), (F.col("_rows") - F.col(f"_n{i}")).alias("n_nulls"),
                             F.col(f"_d{i}").alias("n_distinct"), *[(F.col(f"_{k}{i}") if k in out else F.lit(None)).cast(t).alias(k) for k, t in nothing.items()]))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose foreign key has no parent (left anti join)."""
    p = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return child.join(p, F.col(child_key) == F.col("_pk"), "left_anti")


def orphan_report(checks: Sequence[tuple[str, DataFrame, DataFrame, str, str]]) -> DataFrame:
    """One row per foreign key: (fk, n_orphans); checks are
    (name, child, parent, child_key, parent_key)."""
    parts = [orphans(c, p, ck, pk).agg(F.count(F.lit(1)).alias("n_orphans"))
             .select(F.lit(name).alias("fk"), "n_orphans")
             for name, c, p, ck, pk in checks]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def dedupe_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key under ``order`` (make it total). ``max_by`` over a
    struct of the row is a partial aggregate: a hot key is reduced to one row
    per map task before the shuffle, unlike ``row_number`` over a window."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def normalise_text(col: str | Column) -> Column:
    """lower-case, whitespace runs to one space, trimmed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.lower(F.regexp_replace(c, r"\s+", " ")))


def duplicate_groups(df: DataFrame, text: str, id_col: str, normalise: bool = True) -> DataFrame:
    """Groups of equal (optionally normalised) text with more than one row. The
    shuffle carries a SHA-256 of the text, not the text itself."""
    t = normalise_text(text) if normalise else F.col(text)
    return (df.groupBy(F.sha2(t, 256).alias("text_hash"))
              .agg(F.count(F.lit(1)).alias("n_docs"), F.min(id_col).alias("min_id"),
                   F.max(id_col).alias("max_id"))
              .where(F.col("n_docs") > 1))


def safe_cast(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Cast columns with ``try_cast``: values that do not convert become null
    instead of failing the job (ANSI mode raises on a bad ``cast``)."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in spec.items()})


def cast_failures(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Per column of ``spec``: non-null inputs that fail to convert."""
    aggs = [F.sum(F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), 1).otherwise(0))
            .cast("long").alias(c) for c, t in spec.items()]
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                  F.col(c).alias("n_failed")) for c in spec])))


def impute(df: DataFrame, col: str, by: Sequence[str], how: str = "median",
           name: str | None = None) -> DataFrame:
    """Fill nulls of ``col`` with the group's median (exact, distributed) or
    mean; adds ``name`` (default ``<col>_filled``)."""
    by = list(by)
    if how == "median":
        stats = exact_quantiles(df, col, [0.5], by=by, names=["_fill"])
    elif how == "mean":
        stats = df.groupBy(*by).agg(F.avg(col).alias("_fill"))
    else:
        raise ValueError(how)
    out = attach_statistics(df, stats, by, "left", "fills") if by else df.withColumn("_fill", stats.select("_fill").scalar())
    return out.withColumn(name or f"{col}_filled", F.coalesce(F.col(col), F.col("_fill"))).drop("_fill")


def iqr_outliers(df: DataFrame, col: str, by: Sequence[str] = (), k: float = 1.5,
                 tiebreak: Sequence[str] = ()) -> DataFrame:
    """Rows outside [q1 - k*iqr, q3 + k*iqr] of their group (exact quartiles)."""
    by = list(by)
    q = exact_quantiles(df, col, [0.25, 0.75], by=by, names=["_q1", "_q3"], tiebreak=tiebreak)
    q = (q.withColumn("lo_fence", F.col("_q1") - k * (F.col("_q3") - F.col("_q1")))
          .withColumn("hi_fence", F.col("_q3") + k * (F.col("_q3") - F.col("_q1")))
          .drop("_q1", "_q3"))
    if by:
        j = attach_statistics(df, q, by, name="fences")
    else:
        # a single row of fences: scalar subqueries, no join at all
        j = df.withColumns({"lo_fence": q.select("lo_fence").scalar(),
                            "hi_fence": q.select("hi_fence").scalar()})
    return j.where((F.col(col) < F.col("lo_fence")) | (F.col(col) > F.col("hi_fence")))


def clip(df: DataFrame, col: str, lo: float, hi: float, name: str | None = None) -> DataFrame:
    """Winsorise ``col`` to [lo, hi]."""
    return df.withColumn(name or col, F.least(F.greatest(F.col(col), F.lit(lo)), F.lit(hi)))


def bin_counts(df: DataFrame, col: str, lo: float, hi: float, n: int) -> DataFrame:
    """Histogram with ``n`` equal buckets over [lo, hi): bucket 1..n, 0 below,
    n+1 at or above ``hi`` (``width_bucket`` numbering); nulls are not counted."""
    width = (hi - lo) / n
    x = F.col(col)
    b = (F.when(x < lo, 0).when(x >= hi, n + 1)
          .otherwise(F.floor((x - F.lit(lo)) / F.lit(width)) + 1)).cast("long")
    out = df.where(x.isNotNull()).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    inside = (F.col("bucket") >= 1) & (F.col("bucket") <= n)
    return (out.withColumn("lo_edge", F.when(inside, F.lit(lo) + (F.col("bucket") - 1) * F.lit(width)))
               .withColumn("hi_edge", F.when(inside, F.lit(lo) + F.col("bucket") * F.lit(width))))
