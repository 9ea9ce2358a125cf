"""Registry of check queries and their oracle SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def check(key: str, sql: str | None = None):
    def register(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register
