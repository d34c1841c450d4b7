"""Registered queries."""

from importlib import import_module

MODULES = ("market", "share", "quality", "vectors", "discovery", "files")


def load_all():
    """Import every plan module and return the registry they filled."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.registry")
