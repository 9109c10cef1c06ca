"""Queries and oracle SQL of this subpackage, gathered from its modules."""

from __future__ import annotations

from . import bpe, chat, decontaminate, htmlcrf, merkle, neardup, phrases, pii, quality, spelling, substring, suffix, tokencount

MODULES = [neardup, htmlcrf, bpe, merkle, pii, tokencount, suffix, chat, quality, decontaminate, phrases, spelling, substring]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
