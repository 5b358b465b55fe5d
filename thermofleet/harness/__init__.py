"""Every operator as a query over the driver's tables, with the SQL that must give the same rows."""

from importlib import import_module

PARTS = ["series", "tables", "formulas", "planning", "decided", "alerts", "fits", "streams", "learning", "landed", "days"]


def load():
    """The registry with every part imported."""
    for part in PARTS:
        import_module(f"thermofleet.harness.{part}")
    return import_module("thermofleet.harness.registry")
