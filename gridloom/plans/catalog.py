"""All queries of the library, by name."""

from gridloom.plans import analytics, profiling, validation  # noqa: F401
from gridloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
