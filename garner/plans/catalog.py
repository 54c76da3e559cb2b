"""Every core query and its SQL, collected from the plan modules."""

from __future__ import annotations

from garner.plans import calendar, conversations, people, places, records, search, sources, streams, summaries, training, updates

_MODULES = (training, records, summaries, search, people, conversations, calendar, updates, places, sources, streams)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
