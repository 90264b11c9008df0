"""All registered queries of the engine and their DuckDB oracles."""

from __future__ import annotations

from importlib import import_module

from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

for _module in ("engagement", "audience", "captions", "joining", "modelling", "checking", "crawling", "storage", "learning"):
    import_module(f"{__package__}.{_module}")
