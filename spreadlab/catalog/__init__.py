"""Query catalog: every operator bound to the provided tables."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every catalog module once and return the registry."""
    registry = importlib.import_module("spreadlab.catalog.registry")
    for m in pkgutil.iter_modules(__path__):
        if m.name not in ("registry", "oracle_parts"):
            importlib.import_module(f"spreadlab.catalog.{m.name}")
    return registry
