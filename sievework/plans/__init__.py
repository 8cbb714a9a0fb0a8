"""Registered queries, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    for m in pkgutil.iter_modules(__path__):
        if m.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{m.name}")
