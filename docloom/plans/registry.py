"""All queries of the reference's own operators, with their oracle SQL."""

from __future__ import annotations

from docloom.plans import ask, library, planner, rag, retrieval, tables, textjobs  # noqa: F401  they register on import
from docloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
