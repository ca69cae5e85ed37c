"""Registered queries, one module per part of the operator inventory."""

from importlib import import_module

MODULES = (
    "audit_queries",
    "table_queries",
    "metric_queries",
    "resample_queries",
    "provenance_queries",
    "model_queries",
    "tree_queries",
)


def load_all():
    """Import every query module and return the registry they filled."""
    for name in MODULES:
        import_module(f"concord.plans.{name}")
    return import_module("concord.plans.registry")
