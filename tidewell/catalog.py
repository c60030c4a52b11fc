"""Registry of the engine's queries and their SQL twins."""

from __future__ import annotations

from .plans import queries_archive, queries_live, queries_ranges, queries_reduce, queries_sky, queries_tod, queries_wider  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "map_solve_tqu"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
