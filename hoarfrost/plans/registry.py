"""Where the climate queries and the SQL that they are checked against are registered."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame by its name, with DuckDB SQL where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
