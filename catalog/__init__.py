"""Registered queries: every operator on the driver's tables, with SQL to compare against."""

from . import learning, scores, sequence  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
