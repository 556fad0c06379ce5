"""Registered queries with their DuckDB equivalents."""

from __future__ import annotations

import importlib

MODULES = ("feature_queries", "market_queries", "trading_queries", "result_queries", "report_queries", "document_queries", "ledger_queries", "plan_queries")


def load_all() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"tickloom.queries.{name}")
    from tickloom.queries.base import ORACLE, QUERIES
    return QUERIES, ORACLE
