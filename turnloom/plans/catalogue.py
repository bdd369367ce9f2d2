"""The core query catalogue: every reference operator as (spark, dir) -> DataFrame, with its oracle SQL."""

from __future__ import annotations

from turnloom.plans import q_conversation, q_curation, q_joins, q_metrics, q_training

_MODULES = [q_conversation, q_curation, q_joins, q_metrics, q_training]
QUERIES = {name: fn for m in _MODULES for name, (fn, _) in m.CATALOGUE.items()}
SQL = {name: sql for m in _MODULES for name, (_, sql) in m.CATALOGUE.items() if sql}
