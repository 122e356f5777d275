"""All queries of the core, by name."""

from __future__ import annotations

from marlstone.plans import basics, inference, panel, prepare, relational, series, stream, study

_PARTS = (prepare, series, relational, study, inference, panel, stream, basics)
FLAGSHIP = "d5_labels"
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
SQL = {name: s for part in _PARTS for name, s in part.SQL.items()}
