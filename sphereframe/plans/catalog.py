"""Imports every module that registers queries."""

from __future__ import annotations

from importlib import import_module

from .registry import QUERIES, Query

MODULES = ("sources", "reshaping", "alignment", "statistics", "verification", "sampling", "spherical", "networks", "streams", "layouts")


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        import_module(f"{__package__}.{module}")
    return dict(QUERIES)
