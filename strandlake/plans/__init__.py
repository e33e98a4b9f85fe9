"""Registered queries over the driver's tables, with their SQL oracles."""

from __future__ import annotations

import importlib

MODULES = ("scalar", "catalog", "intervals", "reads", "variants", "sequences", "comparison", "files")


def _load():
    for m in MODULES:
        importlib.import_module(f"strandlake.plans.{m}")
    return importlib.import_module("strandlake.plans.registry")


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
