"""All of the engine's registered queries."""

from tellurix.plans import aggregation, extension, relational, scalar, temporal, verification  # noqa: F401  each registers its own
from tellurix.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
