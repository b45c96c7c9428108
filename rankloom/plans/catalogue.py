"""All registered queries of the library proper, and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["boards", "datasets", "evaluation", "models", "neighbours", "residues", "results"]


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"rankloom.plans.{name}"), what)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
