"""Registered queries over the given tables and their SQL twins."""

from importlib import import_module
from pkgutil import iter_modules


def all_plans() -> None:
    """Import every module of this package so that its queries are registered."""
    for m in sorted(iter_modules(__path__), key=lambda m: m.name):
        import_module(f"{__name__}.{m.name}")
