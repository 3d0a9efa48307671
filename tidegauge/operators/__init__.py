"""Operators of the measurement study, by family."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of this package so that it registers its queries."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
