"""All registered queries and their SQL."""

from voltmap.plans import stored  # noqa: F401  (registers its queries)
from voltmap.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
