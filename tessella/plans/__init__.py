"""Registered queries and the small tables that they need."""

from tessella.plans import built, documents  # noqa: F401  (they register their queries)
from tessella.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
