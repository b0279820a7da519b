"""The registered queries of the subpackage."""

from __future__ import annotations

import importlib
import pkgutil

from skyledger import llm
from skyledger.llm.base import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    for module in sorted(m.name for m in pkgutil.iter_modules(llm.__path__) if m.name != "queries"):
        importlib.import_module(f"{llm.__name__}.{module}")
    return dict(QUERIES), dict(ORACLES)
