"""Every registered query and its SQL, gathered from the modules of this folder."""

from __future__ import annotations

from spanloom.plans import caption_queries, render_queries, span_queries, text_queries

MODULES = (span_queries, text_queries, caption_queries, render_queries)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
