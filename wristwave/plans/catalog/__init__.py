"""Registered queries, grouped like the operator inventory."""

from __future__ import annotations

import importlib

from wristwave.plans.registry import ORACLES, QUERIES

_MODULES = [
    "scalars", "cleaning", "sequences", "statistics", "alignment", "ranking",
    "signals", "sqltext", "learning", "io", "jobs", "live",
]


def load() -> tuple[dict, dict]:
    for name in _MODULES:
        importlib.import_module(f"wristwave.plans.catalog.{name}")
    return QUERIES, ORACLES
