"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from .plans.oracle import ORACLE_SQL
from .plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
