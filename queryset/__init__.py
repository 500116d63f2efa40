"""The registered queries: each runs one operator over whole tables, most with an SQL check."""

from __future__ import annotations

from queryset import analyses, cleaning, grouping, models, selection, statistics, tables, texts, vectors

_MODULES = (tables, cleaning, statistics, selection, models, vectors, grouping, texts, analyses)


def all_queries() -> dict:
    return {name: run for m in _MODULES for name, (run, _) in m.REGISTRY.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.REGISTRY.items() if sql}
