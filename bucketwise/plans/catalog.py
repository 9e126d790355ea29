"""All registered queries."""

from bucketwise.plans import (  # noqa: F401
    model_queries, payload_queries, route_queries, snapshot_queries, table_queries, text_queries, time_queries,
)
from bucketwise.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
