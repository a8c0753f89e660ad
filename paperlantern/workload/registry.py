"""``QUERIES[name]`` takes ``(spark, sf_dir)``; ``ORACLES[name]`` is the SQL text."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep
