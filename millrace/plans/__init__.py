"""The registered queries: one per operator, each with the SQL that must agree with it."""

from __future__ import annotations

import importlib
import pkgutil

from millrace.plans.registry import ORACLES, QUERIES

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
