"""Bindings of the operators to the shared test tables, with the SQL each one must agree with."""

from __future__ import annotations

import importlib

MODULES = ["scalars", "pages", "filters", "ordering", "reconcile", "merging", "stats", "registries", "jobs", "storage"]


def all_catalogs():
    found = []
    for name in MODULES:
        try:
            found.append(importlib.import_module(f"serialake.catalog.{name}").catalog)
        except ModuleNotFoundError as error:
            if error.name != f"serialake.catalog.{name}":
                raise
    return found
