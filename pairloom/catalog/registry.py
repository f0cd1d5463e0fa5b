"""Small helpers used by the catalog modules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rd(c, digits: int = 9) -> Column:
    """Nine digits and no negative zero, so that value hashes agree."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def register(queries: dict, sqls: dict):
    """Decorator factory: ``@reg("name", sql_text)`` records a query."""

    def reg(name: str, sql: str | None = None):
        def deco(fn):
            queries[name] = fn
            if sql:
                sqls[name] = sql
            return fn

        return deco

    return reg
