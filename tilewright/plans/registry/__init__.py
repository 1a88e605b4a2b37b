"""Registered queries, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("shapes", "profiling", "tiling", "grids", "evaluation", "training", "objects", "streams", "jobs")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        found = getattr(import_module(f"{__name__}.{family}"), attribute)
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(found)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLES")
