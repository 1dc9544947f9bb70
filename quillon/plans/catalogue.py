"""All queries of the engine proper, with the SQL that they are checked against."""

from __future__ import annotations

import importlib

from quillon.plans.registry import COVERS, ORACLES, QUERIES

for _name in ("q_match", "q_stats", "q_graph", "q_facets", "q_retrieve", "q_text", "q_audit", "q_layout", "q_more"):
    importlib.import_module(f"quillon.plans.{_name}")

__all__ = ["COVERS", "ORACLES", "QUERIES"]
