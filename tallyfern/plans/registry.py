"""All registered queries and their SQL oracles."""

from __future__ import annotations

import importlib

MODULES = (
    "text_queries",
    "table_queries",
    "monitor_queries",
    "ask_queries",
    "model_queries",
    "stream_queries",
    "window_queries",
    "record_queries",
    "file_queries",
    "saved_queries",
)


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(importlib.import_module(f"tallyfern.plans.{name}"), attribute))
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLES")
