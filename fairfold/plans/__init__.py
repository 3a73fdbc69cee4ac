"""Registered queries, grouped by the question they answer."""

from __future__ import annotations

import importlib

GROUPS = ("measure", "setup", "evidence", "diagnose", "compete", "intake")


def load_queries():
    """Import every group once and return (queries, oracle SQL)."""
    for group in GROUPS:
        importlib.import_module(f"fairfold.plans.{group}")
    from fairfold.plans import registry

    return registry.QUERIES, registry.ORACLES
