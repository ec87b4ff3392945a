"""The operators run over the given tables, each with an SQL text that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ["metrics", "logs", "traces", "otlp", "alerts", "storage", "indexed"]


def load():
    """The registry, filled."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.registry")
