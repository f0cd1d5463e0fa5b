"""Registered queries and their SQL counterparts, by area."""

from __future__ import annotations

import importlib

AREAS = ["functions", "sources", "filters", "joins", "splits", "negatives", "aggregates", "metrics", "models"]


def _collect(kind: str) -> dict:
    out: dict = {}
    for area in AREAS:
        mod = importlib.import_module(f"pairloom.catalog.{area}")
        out |= getattr(mod, kind)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("SQL")
