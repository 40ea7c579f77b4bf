"""Named query plans over the benchmark tables."""

from importlib import import_module


def load():
    """Import every query module and return the registry."""
    for name in ("metrics", "tables", "spatial", "raster", "flows"):
        import_module(f"patchloom.plans.queries_{name}")
    return import_module("patchloom.plans.registry")
