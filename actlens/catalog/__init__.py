"""Registered queries: each operator on the given tables, with its SQL twin."""

from __future__ import annotations

import importlib

from actlens.catalog.registry import ORACLES, QUERIES

for _module in ("sampling", "text", "vectors", "explain", "build", "rollouts", "shards"):
    importlib.import_module(f"actlens.catalog.{_module}")

__all__ = ["QUERIES", "ORACLES"]
