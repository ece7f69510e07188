"""Every registered query of the engine and the SQL that states the same result."""

from __future__ import annotations

from . import q_catalogues, q_evaluate, q_monitoring, q_qa, q_records, q_replay, q_sequence, q_sources, q_state, q_stream, q_vitals, q_windows

MODULES = [q_state, q_sequence, q_windows, q_vitals, q_monitoring, q_evaluate, q_qa, q_records, q_catalogues, q_sources, q_replay, q_stream]
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
FLAGSHIP = "trend_dashboard"
