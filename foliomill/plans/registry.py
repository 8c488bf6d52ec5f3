"""Core queries and their SQL, by name."""

from __future__ import annotations

from foliomill.plans import drifts, hierarchies, records, regions, reviews, workspace, rasters, geometry, provenance, streams, tables, decisions

MODULES = [hierarchies, drifts, records, regions, reviews, workspace, rasters, geometry, provenance, streams, tables, decisions]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def sql() -> dict:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
