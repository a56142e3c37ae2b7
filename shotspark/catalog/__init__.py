"""Registered queries: each operator over the test tables, with its SQL twin."""

from __future__ import annotations

from importlib import import_module

FAMILIES = (
    "sources", "admission", "coordinates", "chunking", "detection", "scenes",
    "tracking", "delivery", "status", "results", "analytics", "metrics",
)


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    oracle: dict = {}
    for name in FAMILIES:
        module = import_module(f"shotspark.catalog.{name}")
        assert not queries.keys() & module.QUERIES.keys()
        queries.update(module.QUERIES)
        oracle.update(module.ORACLE)
    return queries, oracle
