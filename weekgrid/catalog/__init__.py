"""Registered queries. Importing a module of this package registers what it declares."""

from __future__ import annotations

from importlib import import_module

MODULES = ["panel_queries", "audit_queries", "model_queries", "operator_queries"]


def load_all():
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.registry")
