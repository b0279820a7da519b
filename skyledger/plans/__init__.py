"""Registered queries: every operator run over the given tables."""

from __future__ import annotations

import importlib
import pkgutil

from skyledger.plans.registry import ORACLES, QUERIES


def load_all():
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"{__name__}.{module}")
    return dict(QUERIES), dict(ORACLES)
