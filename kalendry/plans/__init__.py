"""The queries over the driver's tables, and their SQL."""

from kalendry.plans import editions, pages, places, starts, streams, venues  # noqa: F401  (they register their queries)
from kalendry.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
