"""All queries of the library's own operators."""

from percepta.plans import more  # noqa: F401  (its queries are added when it is imported)
from percepta.plans.catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
