"""Registered queries: each pairs a Spark job over the given tables with an equivalent SQL text."""

from __future__ import annotations

import importlib

MODULES = ["features", "evaluation", "ensembles", "matches", "lines", "line_load", "reports", "writes", "models", "streams"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"antecede.catalog.{name}")
