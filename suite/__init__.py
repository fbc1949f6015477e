"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from importlib import import_module

from suite.registry import ORACLE, QUERIES

MODULES = ("domains", "pages", "probe", "scoring", "filters", "writes", "reuse", "answers", "events", "sources")
for _name in MODULES:
    import_module(f"suite.{_name}")

__all__ = ["ORACLE", "QUERIES"]
