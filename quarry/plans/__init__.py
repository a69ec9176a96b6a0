"""Queries over the driver's tables, each with SQL that gives the same rows."""

from quarry.plans import displays, products  # noqa: F401  they register their queries
from quarry.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
