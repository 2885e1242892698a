"""All registered queries with the SQL they are checked against."""

from __future__ import annotations

import importlib

MODULES = ["ingest", "cleaning", "outline", "enrichment", "search", "learning", "library"]

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"quire.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
