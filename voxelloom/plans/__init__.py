"""End-to-end plans and the query catalogue."""

from importlib import import_module

PARTS = ("grading", "clouds", "views", "records", "live", "aligning", "checks")


def load_catalog():
    """The catalogue module with every part registered."""
    for part in PARTS:
        import_module(f"voxelloom.plans.{part}")
    return import_module("voxelloom.plans.catalog")
