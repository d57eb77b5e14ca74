"""All registered queries."""

from mailsift.plans import stream_queries, table_queries, text_queries  # noqa: F401
from mailsift.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
