"""Named queries of the engine on the standard tables, with their SQL equivalents."""

from __future__ import annotations

from ferrolith.plans import cobol_programs, entities, graphs, json_documents, order_programs, programs, searches, stated_programs, texts

PLANS = [texts, entities, graphs, programs, cobol_programs, order_programs, json_documents, searches, stated_programs]
QUERIES = {name: query for plan in PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL = {name: sql for plan in PLANS for name, sql in plan.ORACLE_SQL.items()}
