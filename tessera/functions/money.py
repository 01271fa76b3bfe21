"""Exact money arithmetic.

Prices and discounts are stored as doubles with two decimals. Sums of many
doubles drift in the last digits (at 10^10 the cents are already unsure), so
money is summed as DECIMAL: the product of a 2-decimal price and a 2-decimal
factor is exact at 4 decimals, and decimal sums are exact. Spark keeps
decimals of up to 18 digits in a long, so per-order and per-customer partial
sums stay on the fast path; only the few final group totals widen. Results
are cast to double at the end, which rounds the exact value once. A value
that has more decimals than its type, or more digits, raises: it is never
rounded in silence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE_TYPE = "decimal(12,2)"
RATE_TYPE = "decimal(3,2)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _exact(col, kind: str) -> Column:
    """A double as a decimal, if that is the number it was read from."""
    x = _c(col)
    as_decimal = x.cast(kind)
    wrong = F.raise_error(F.concat(F.lit(f"not a {kind}: "), x.cast("string"))).cast(kind)
    return F.when(x.isNull() | (as_decimal.cast("double") == x.cast("double")), as_decimal).otherwise(wrong)


def price(col) -> Column:
    """A 2-decimal money column as an exact decimal."""
    return _exact(col, PRICE_TYPE)


def net(price_col="l_extendedprice", discount_col="l_discount") -> Column:
    """price * (1 - discount), exact (4 decimals)."""
    return price(price_col) * (F.lit(1) - _exact(discount_col, RATE_TYPE))


def total(expr) -> Column:
    """Exact sum of a decimal money expression, as double."""
    return F.sum(expr).cast("double")


# SQL spellings of the same expressions for the DuckDB oracle.
NET_SQL = "(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(3,2))))"


def price_sql(col: str) -> str:
    return f"CAST({col} AS DECIMAL(12,2))"
