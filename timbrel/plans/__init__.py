"""Registered queries, one module per operator family."""

import importlib
import pkgutil

from .registry import ORACLES, QUERIES


def load_all():
    """Import every query module once; returns (queries, check SQL)."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return QUERIES, ORACLES
