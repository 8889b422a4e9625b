"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

import importlib

from sedimenta.plans.base import QUERIES, SQL

for _name in ("retrieval", "overlays", "aggregates", "graph", "scoring", "incremental", "quality", "writers", "jobs", "applied", "reads"):
    importlib.import_module(f"sedimenta.plans.q_{_name}")

__all__ = ["QUERIES", "SQL"]
