"""Every query of this engine by name, and the SQL that DuckDB can check it with."""

from __future__ import annotations

from . import answers, browse, document, gauges, graph, intake, pieces, rewrite, routed

_PLANS = (answers, browse, document, gauges, graph, intake, pieces, rewrite, routed)
QUERIES: dict = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
FLAGSHIP = answers.answers
