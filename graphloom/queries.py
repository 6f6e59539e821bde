"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from graphloom import queries_docs, queries_graph, queries_kept, queries_search

QUERIES = {**queries_graph.QUERIES, **queries_search.QUERIES, **queries_docs.QUERIES, **queries_kept.QUERIES}
SQL = {**queries_graph.SQL, **queries_search.SQL, **queries_docs.SQL, **queries_kept.SQL}
