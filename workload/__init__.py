"""Queries over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

from workload import catalog, clean, export, extract, plans, profile

MODULES = (extract, clean, profile, plans, export, catalog)


def all_queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
