"""Queries over the given tables, one module per field of work."""

from importlib import import_module

MODULES = ("history", "checks", "evaluation", "decisions", "sourcing", "modelling")


def load_all() -> None:
    for module in MODULES:
        import_module(f"{__name__}.{module}")
