"""Where query modules register what they define."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name, with the DuckDB SQL that must give the same rows."""
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put
