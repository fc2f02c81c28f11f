"""All registered queries and their SQL twins."""

from __future__ import annotations

from docweave.plans import (
    conversation_queries,
    extraction_queries,
    graph_queries,
    metric_queries,
    model_queries,
    network_queries,
    resolution_queries,
    retrieval_queries,
    text_queries,
)

_MODULES = (
    graph_queries,
    extraction_queries,
    network_queries,
    resolution_queries,
    retrieval_queries,
    text_queries,
    conversation_queries,
    metric_queries,
    model_queries,
)


def all_queries():
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def all_sql():
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
