"""Queries over the driver's tables, each beside the SQL that gives the same rows."""

from massloom.plans import library as _library, structures as _structures  # noqa: F401  (register their queries)
from massloom.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
