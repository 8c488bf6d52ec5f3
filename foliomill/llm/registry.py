"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from foliomill.llm import corpus, details, reports

MODULES = [reports, details, corpus]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def sql() -> dict:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
