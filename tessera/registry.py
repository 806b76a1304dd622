"""All queries of the core and their SQL."""

from __future__ import annotations

from tessera import queries_corpus, queries_graph, queries_references

MODULES = (queries_corpus, queries_graph, queries_references)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
