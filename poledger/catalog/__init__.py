"""Registered queries and their SQL counterparts."""

from __future__ import annotations

import importlib

MODULES = ("clean", "pages", "rules", "scoring", "ingest", "routing", "service", "prepare", "sources")


def load():
    """All queries by name, in catalogue order."""
    for name in MODULES:
        importlib.import_module(f"poledger.catalog.{name}")
    from poledger.catalog.registry import REGISTRY

    return REGISTRY
