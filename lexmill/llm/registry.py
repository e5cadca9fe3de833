"""Queries op1 to op10 and their SQL, gathered from the operator modules."""

from __future__ import annotations

from lexmill.llm import dedup, edits, html, images, packing, pii, quality, sharding, tokenizer, urls

MODULES = (pii, quality, edits, dedup, tokenizer, images, html, sharding, packing, urls)


def queries() -> dict:
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
