"""Registered queries and their SQL checks."""

from amberline.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
