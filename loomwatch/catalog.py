"""All registered queries of the core library, with their SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules of ``loomwatch.plans`` with QUERIES and SQL.
MODULES: tuple[str, ...] = ("texts", "graphs", "state", "payloads", "merges")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"loomwatch.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"loomwatch.plans.{m}").SQL.items()}
