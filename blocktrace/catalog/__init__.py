"""Registered queries and their SQL equivalents."""

from blocktrace.catalog import place, policies, raw, score, stream, trace  # noqa: F401
from blocktrace.catalog.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
