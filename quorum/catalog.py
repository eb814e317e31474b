"""Every registered query of the statistical engine, with its oracle SQL."""

from __future__ import annotations

from quorum.queries import bias, judging, judgments, monitoring, reports, study

FLAGSHIP = "pairwise_cluster_se"
_MODULES = (judgments, bias, judging, reports, study, monitoring)
QUERIES: dict = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
