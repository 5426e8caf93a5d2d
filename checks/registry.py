"""Collects the queries of all check modules with the SQL statement each must agree with."""
from __future__ import annotations

import importlib

MODULES = ["scans", "asof", "features", "detect", "decisions", "memory", "graph", "evaluation", "investigation", "streams"]

_QUERIES: dict = {}
_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return add


def load():
    for m in MODULES:
        importlib.import_module(f"checks.{m}")
    return dict(_QUERIES), dict(_SQL)
