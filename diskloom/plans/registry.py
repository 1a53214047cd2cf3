"""All queries of the core, by name."""

from __future__ import annotations

from diskloom.plans import catalogue_queries, core_queries, detail_queries, form_queries, importing_queries, library_queries, relational_queries, text_queries

_MODULES = (core_queries, relational_queries, text_queries, catalogue_queries, importing_queries, form_queries, library_queries, detail_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
