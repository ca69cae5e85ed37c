"""Registered queries of this package: one for each operator, over whole tables."""

from __future__ import annotations

from importlib import import_module

from concord.llm.registry import ORACLES, QUERIES

MODULES = ("toxicity_query", "packing_query", "jaccard_query", "archive_query", "secrets_query", "lines_query", "decontaminate_query", "langid_query", "forest_query", "toolcalls_query", "simhash_query", "lexical_query", "negatives_query")

for _name in MODULES:
    import_module(f"concord.llm.{_name}")

__all__ = ["QUERIES", "ORACLES"]
