"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def longs(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]
