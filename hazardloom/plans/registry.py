"""All queries of the core package and their SQL checks."""

from __future__ import annotations

from hazardloom.plans import corpus, dashboard, data_problems, governance, ingestion, monitoring, pipeline, streams, texts

MODULES = (data_problems, dashboard, monitoring, texts, pipeline, governance, ingestion, corpus, streams)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
