"""Named jobs over the fixture tables, each paired with an oracle SQL text.

Importing this package registers every job; ``QUERIES`` and ``ORACLE`` are
the two views of the registry used by ``__spark_entry__.py``.
"""

from tessera.plans.registry import ORACLE, QUERIES, register
from tessera.plans import (  # noqa: F401  (imports register the jobs)
    sales, relational, timeseries, customers, cleaning, scalar, experiments, streams, io,
)

__all__ = ["QUERIES", "ORACLE", "register"]
