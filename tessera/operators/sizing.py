"""Broadcast only behind a size check.

``bounded_broadcast`` counts at most ``max_rows + 1`` rows of the candidate
side (a LIMIT job that stops early) and marks it for broadcast only when it is
within the bound; otherwise the side is returned unchanged and Spark plans a
shuffle join (which AQE may still turn into a broadcast at run time when the
measured size is small).

Use it for sides that are cheap to count: source tables and caller-supplied
tables. A side derived from the big input (an aggregate, a statistics table)
would be computed twice, once for the count and once in the query;
``attach_statistics`` writes it once, measures it in bytes, and then either
broadcasts it or joins it on salted keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import persist_table

DEFAULT_MAX_ROWS = 100_000


def fits(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    return F.broadcast(df) if fits(df, max_rows) else df


BROADCAST_BYTES = 16 << 20


def measured_bytes(table: DataFrame) -> int:
    """Bytes of the rows of a written table, as text."""
    return table.agg(F.sum(F.octet_length(F.to_json(F.struct(*table.columns))))).first()[0] or 0


def broadcast_if_small(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if its rows take up to ``max_bytes``."""
    return F.broadcast(table) if measured_bytes(table) <= max_bytes else table


def attach_statistics(df: DataFrame, stats: DataFrame, on: Sequence[str], how: str = "inner", name: str = "statistics",
                      max_bytes: int = BROADCAST_BYTES, salts: int = 32) -> DataFrame:
    """``df`` joined with a table of one row per group that was derived from it (``how``: inner or left).

    ``stats`` is written once and its rows are measured as text. Up to ``max_bytes`` it
    is broadcast, so the large side is not shuffled. Beyond that every group is there
    ``salts`` times, and rows of ``df`` are dealt over these by their place, so a group that
    holds a third of the rows is joined by that many tasks. As in SQL, null keys match nothing."""
    on = list(on)
    stats = persist_table(stats, name)
    if measured_bytes(stats) <= max_bytes:
        return df.join(F.broadcast(stats), on, how)
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    dealt = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")
