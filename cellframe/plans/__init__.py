"""Registered queries with their oracle SQL."""

from __future__ import annotations

import importlib
import importlib.util

_MODULES = ("filter_queries", "cell_queries", "lineage_queries", "cycle_queries", "stats_queries",
            "source_queries", "channel_queries", "image_queries", "linking_queries", "focus_queries",
            "stream_queries")


def _load():
    from . import registry
    for m in _MODULES:
        if importlib.util.find_spec(f"{__name__}.{m}"):
            importlib.import_module(f"{__name__}.{m}")
    return registry


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_oracles() -> dict:
    return dict(_load().ORACLES)
