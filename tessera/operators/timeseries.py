"""Time series and calendar operators.

Windows here run over per-period aggregates (one row per group and period), so
their size is bounded by the time span, not by the number of input rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import carry_forward


def forward_fill(df: DataFrame, col: str, by: Sequence[str], ts: str, *,
                 tiebreak: Sequence[str] = (), grain: str = "1 day") -> DataFrame:
    """Last known (non-null) value of ``col`` at each row, per group, in time
    order (``<col>_ffill``); split by time bucket, see ``carry_forward``."""
    return carry_forward(df, by, ts, [col], tiebreak=tiebreak, grain=grain)


def period_change(df: DataFrame, by: Sequence[str], period: str, value: str) -> DataFrame:
    """Previous period's value (``prev_<value>``) and growth ``(v - prev) / prev``
    (null when there is no previous period or it is zero)."""
    w = Window.partitionBy(*by).orderBy(period)
    prev = F.lag(value).over(w)
    return (df.withColumn(f"prev_{value}", prev)
              .withColumn("growth", F.try_divide(F.col(value) - F.col(f"prev_{value}"),
                                                 F.col(f"prev_{value}"))))


def moving_average(df: DataFrame, by: Sequence[str], order: str, value: str, n: int,
                   name: str | None = None) -> DataFrame:
    """Mean of the last ``n`` rows (this one included) per group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumn(name or f"ma{n}_{value}", F.avg(value).over(w))


def trailing_interval(df: DataFrame, by: Sequence[str], day: str, values: Sequence[str],
                      days: int) -> DataFrame:
    """Sums over the calendar span of the last ``days`` days (this day included),
    whatever the number of rows in it: a RANGE frame over the day number."""
    w = (Window.partitionBy(*by).orderBy(F.unix_date(F.col(day)))
         .rangeBetween(-(days - 1), 0))
    out = df
    for v in values:
        out = out.withColumn(f"{v}_{days}d", F.sum(v).over(w))
    return out


def calendar_fill(counts: DataFrame, keys: DataFrame, day: str, start: Column, end: Column,
                  fill: dict[str, object]) -> DataFrame:
    """One row per key and calendar day in [start, end]; days without data get
    ``fill`` values. ``start`` / ``end`` are scalar columns (e.g. a scalar
    subquery); the calendar is generated per key with ``sequence`` + ``explode``,
    so no cross join is planned. ``counts`` holds keys, ``day`` and the values."""
    key_cols = keys.columns
    cal = keys.withColumn(day, F.explode(F.sequence(start, end, F.expr("INTERVAL 1 DAY"))))
    out = cal.join(counts, on=[*key_cols, day], how="left")
    for c, v in fill.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def calendar_features(df: DataFrame, ts: str, ref_date: str, prefix: str = "") -> DataFrame:
    """Year, quarter, ISO week, ISO weekday (Monday = 1), month start and age in
    days relative to ``ref_date``. Integer parts are returned as bigint."""
    d = F.to_date(F.col(ts))
    return df.select(
        "*",
        F.year(d).cast("long").alias(f"{prefix}year"),
        F.quarter(d).cast("long").alias(f"{prefix}quarter"),
        F.weekofyear(d).cast("long").alias(f"{prefix}iso_week"),
        (F.weekday(d) + 1).cast("long").alias(f"{prefix}iso_dow"),
        F.trunc(d, "month").alias(f"{prefix}month_start"),
        F.datediff(F.lit(ref_date).cast("date"), d).cast("long").alias(f"{prefix}age_days"),
    )
