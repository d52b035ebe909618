"""Batch twins of the streaming marts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.plans.registry import query
from millrace.sources.testdata import Staging
from millrace.streaming import marts


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE) AS value FROM events GROUP BY ALL")
def t_daily_window(s: Staging) -> DataFrame:
    return marts.daily(s.events())


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k""")
def t_session_window(s: Staging) -> DataFrame:
    return marts.sessions(s.events())


@query("""SELECT d + INTERVAL 7 DAY AS until, event_type, count(*) AS n FROM (SELECT event_type, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS d FROM events) GROUP BY ALL""")
def t_sliding_window(s: Staging) -> DataFrame:
    return marts.sliding(s.events())
