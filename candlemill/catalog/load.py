"""Import every catalog module and hand out the registry."""

from __future__ import annotations

import importlib

from candlemill.catalog.registry import QUERIES, SQL

MODULES = ("bars_and_features", "trading", "pattern_rows", "evaluation", "dataset_rows", "checks_and_io", "models_and_streams")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"candlemill.catalog.{name}")


def queries():
    _load()
    return dict(QUERIES)


def sql():
    _load()
    return dict(SQL)
