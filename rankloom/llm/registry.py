"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib

#: Modules that register queries.
MODULES = ["langid", "merkle", "near_vectors", "ngram_join", "packing", "periodic", "pieces", "pii", "quality", "suffixes", "token_counts", "toxicity", "turns"]


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"rankloom.llm.{name}"), what)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
