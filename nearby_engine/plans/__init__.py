"""Plans over landed tables and evidence."""

import importlib

GROUPS = ["catalog_search", "catalog_functions", "catalog_sources", "catalog_merge", "catalog_runs", "catalog_depth"]


def load_catalog() -> None:
    """Register every query."""
    for group in GROUPS:
        importlib.import_module(f"nearby_engine.plans.{group}")
