"""Queries of the text and matching problems and the SQL of those that DuckDB can express."""

from __future__ import annotations

from garner.llm import plan_addresses, plan_conversations, plan_entities, plan_mail, plan_pii, plan_residue, plan_sizing

_MODULES = (plan_addresses, plan_conversations, plan_entities, plan_mail, plan_pii, plan_residue, plan_sizing)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
