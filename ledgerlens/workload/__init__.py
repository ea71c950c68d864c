"""The registered queries, by area."""

import importlib

AREAS = ["rows", "windows", "segments", "evaluation", "splits", "io", "pipeline", "learning", "streams"]


def load():
    """Import every area once and return the registry module."""
    from ledgerlens.workload import registry

    for area in AREAS:
        importlib.import_module(f"ledgerlens.workload.{area}")
    return registry
