"""All registered queries of the engine's own operators, and the SQL that they can be held against."""

from __future__ import annotations

from tidewater.plans import compute, passthrough, relational
from tidewater.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "compute", "passthrough", "relational"]
