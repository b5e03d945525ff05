"""Streaming queries, run over all events that are there."""

from __future__ import annotations

from marginalia.plans.registry import query
from marginalia.streaming import events as ev


@query("SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    return ev.run_updates(ev.tumbling(ev.event_stream(spark, d), "1 day"), ["start_us", "event_type"])


@query("SELECT s AS start_us, count(*) AS n FROM (SELECT unnest([epoch_us(time_bucket(INTERVAL 6 HOUR, ts)), epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) - 21600000000]) AS s FROM events) GROUP BY 1")
def stream_sliding(spark, d):
    return ev.run_updates(ev.sliding(ev.event_stream(spark, d), "12 hours", "6 hours"), ["start_us"])


@query("SELECT DISTINCT user_id FROM events")
def stream_enqueue_once(spark, d):
    """The key of every row that was let in."""
    return ev.run_updates(ev.first_of_key(ev.event_stream(spark, d), "user_id"), [], "append").select("user_id")


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT user_id, us, sum(CASE WHEN before IS NULL OR us - before > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS span FROM e)
SELECT user_id, min(us) AS leased_us, max(us) + 600000000 AS expires_us, count(*) AS heartbeats FROM s GROUP BY user_id, span""")
def stream_lease_spans(spark, d):
    """Leases of 600 seconds that a worker's events renew."""
    return ev.run_updates(ev.lease_spans(ev.event_stream(spark, d)), [], "complete")


@query("SELECT user_id, min(event_id) AS first_task, max(event_id) AS last_task, count(*) AS tasks FROM events GROUP BY 1")
def stream_lease_state(spark, d):
    return ev.run_updates(ev.lease_state(ev.event_stream(spark, d)), ["user_id"])


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def stream_ledger(spark, d):
    return ev.run_updates(ev.ledger(ev.event_stream(spark, d)), ["user_id", "event_type"])
