"""All registered queries of the core, and their oracles."""

from __future__ import annotations

import importlib

MODULES = ("lineage", "reports", "search", "taxonomy", "lifecycle", "sessions", "chunking", "more", "state")


def collect() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        m = importlib.import_module(f"strataloom.plans.{name}")
        queries |= m.QUERIES
        oracles |= m.ORACLES
    return queries, oracles
