"""All queries of the engine and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import change_queries, graph_queries, model_queries, source_queries, text_queries, tree_queries, vector_queries

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (text_queries, vector_queries, graph_queries, change_queries, model_queries, tree_queries, source_queries):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
