"""Registered queries over the test tables, each with its oracle SQL where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = ["forms", "clean", "summaries", "markets", "joins", "picks", "ratings", "sources", "quality", "models", "streams"]


def load_registry():
    from kickframe.plans.registry import REGISTRY

    for name in MODULES:
        importlib.import_module(f"kickframe.plans.{name}")
    return REGISTRY
