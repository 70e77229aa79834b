"""The engine's registered queries and their DuckDB equivalents."""

from gridloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
