"""Whole jobs, and the registered queries over the given tables."""

from __future__ import annotations

import importlib

MODULES = ("text_queries", "lookup_queries", "ingest_queries", "evidence_queries", "graph_queries", "scorecard_queries", "evaluation_queries")


def load():
    """Import every query module once and return the registry."""
    for name in MODULES:
        importlib.import_module(f"evidara.plans.{name}")
    return importlib.import_module("evidara.plans.registry")
