"""All queries of the core library and their SQL."""

from __future__ import annotations

from . import corpus, curations, evaluation, graphs, imports, links, retrieval, scalars, streams, structure

MODULES = (structure, retrieval, corpus, graphs, evaluation, scalars, streams, imports, curations, links)
FLAGSHIP = retrieval.bm25_topk


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
