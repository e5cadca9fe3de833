"""All registered queries of the library with their SQL oracles; the training-data operators are not among them."""

from __future__ import annotations

import importlib

NAMES = ("text", "counts", "spell", "tagging", "parsing", "editing")


def _modules() -> list:
    return [importlib.import_module(f"lexmill.plans.{n}") for n in NAMES]


def queries() -> dict:
    return {name: run for m in _modules() for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
