"""Streaming queries and their batch equivalents in SQL."""

from __future__ import annotations

from hazardloom.plans.views import Registry
from hazardloom.streaming import events

REG = Registry()
_SQL = {
    "st01_tumbling_counts": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS starts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "st02_sliding_counts": "SELECT strftime(s, '%Y-%m-%d %H:%M') AS starts, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s FROM events UNION ALL SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1",
    "st03_first_deliveries": "SELECT DISTINCT id FROM reports",
    "st04_user_totals": "SELECT user_id, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS total, first(event_type ORDER BY ts DESC, event_type DESC) AS last_type FROM events GROUP BY 1",
}
for _name, (_table, _make, _keys) in events.STREAMS.items():

    def _run(spark, d, name=_name, source=_table, make=_make, keys=_keys):
        return events.drain(spark, make(events.source(spark, d, source)), name, keys)

    REG.add(_name, _SQL[_name])(_run)

QUERIES, SQL = REG.queries, REG.sql
