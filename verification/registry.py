"""Registered queries, one module per part of the inventory."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` with its equivalent SQL, if there is one."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap
