"""All queries: importing the modules registers them."""

from __future__ import annotations

from importlib import import_module

from .registry import QUERIES, SQL

for _name in ("q_intervals", "q_text", "q_scoring", "q_windows", "q_sampling", "q_tables", "q_review", "q_iterative", "q_fusion", "q_sources", "q_evidence", "q_streaming"):
    import_module(f"{__package__}.{_name}")

__all__ = ["QUERIES", "SQL"]
