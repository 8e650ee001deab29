"""All registered queries and their DuckDB oracles, merged per family."""

from __future__ import annotations

import importlib

FAMILIES = ["doppel.plans.matching", "doppel.plans.review", "doppel.plans.lookups", "doppel.plans.ingest_q"]


def queries() -> dict:
    out: dict = {}
    for mod in FAMILIES:
        out.update(importlib.import_module(mod).QUERIES)
    return out


def oracles() -> dict:
    out: dict = {}
    for mod in FAMILIES:
        out.update(importlib.import_module(mod).ORACLES)
    return out
