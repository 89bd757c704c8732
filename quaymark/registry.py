"""Where query modules put their queries, each with its SQL, and how both sides round."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans.oracle import with_models

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, extra: dict[str, str] | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_models(sql, extra)
        return f
    return register


def fixed(c, digits: int = 6):
    """Rounded on the scaled double, as the SQL does."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") * 10**digits, 0) / 10**digits


def rounded_sql(x: str, digits: int = 6) -> str:
    return f"(round(cast({x} as double) * {10**digits}, 0) / {10**digits})"
