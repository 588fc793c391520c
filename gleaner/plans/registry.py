"""Collects the registered queries and their oracle SQL from the plan modules."""

from __future__ import annotations

import importlib

# plan module -> its oracle module
_MODULES = [
    ("gleaner.plans.links", "gleaner.plans.oracle_links"),
    ("gleaner.plans.scalars", "gleaner.plans.oracle_scalars"),
    ("gleaner.plans.folding", "gleaner.plans.oracle_folding"),
    ("gleaner.plans.retrieval", "gleaner.plans.oracle_retrieval"),
    ("gleaner.plans.ingest_runs", "gleaner.plans.oracle_ingest_runs"),
    ("gleaner.plans.papers_streams", "gleaner.plans.oracle_papers_streams"),
]


def all_queries() -> dict:
    out = {}
    for q, _ in _MODULES:
        out.update(importlib.import_module(q).QUERIES)
    return out


def all_sql() -> dict:
    out = {}
    for _, o in _MODULES:
        out.update(importlib.import_module(o).SQL)
    return out
