"""Queries of request-time state over the events and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stateful as S
from ..session import ship, table
from .ledger_queries import _R, _runs

#: Three tokens, one back every six hours: the events of a user are hours apart.
CAPACITY, RATE = 3, 1 / 21_600
TTL = 86_400


def token_bucket(spark, d):
    ship(spark)
    b = S.token_bucket(table(spark, d, "events"), ["user_id"], "ts", "event_id", CAPACITY, RATE)
    return b.select("user_id", "event_id", "allowed", F.round("tokens", 6).alias("tokens"))


def idempotency_replay(spark, d):
    """Event types as keys of each user's requests, the payload's parity as their digest."""
    ship(spark)
    e = table(spark, d, "events").withColumn("digest", F.pmod(F.col("event_id"), F.lit(2)))
    return S.idempotency(e, ["user_id", "event_type"], "ts", "event_id", "digest", TTL)


def running_budget(spark, d):
    r = _runs(spark, d).filter("workspace_id is not null and created_at is not null")
    return S.running_budget(r, ["workspace_id"], ["created_at", "request_id"], "total_tokens", 10_000).select("workspace_id", "request_id", "spent", "within")


def retry_delays(spark, d):
    """Exponential delays of up to four attempts after each kind of failure."""
    f = table(spark, d, "runs").select("execution_status").distinct().filter("execution_status like '%error' or execution_status = 'timeout'")
    return f.select("execution_status", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attempt")).withColumn("delay", F.pow(F.lit(2.0), F.col("attempt") - 1))


def event_windows(spark, d):
    """Tumbling hours by event type (an extension: what the streaming form counts behind a watermark)."""
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


QUERIES = {f.__name__: f for f in (token_bucket, idempotency_replay, running_budget, retry_delays, event_windows)}

ORACLE = {
    "token_bucket": f"""
        WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL),
        b AS (SELECT user_id, event_id, t, k, true AS allowed, {CAPACITY}::DOUBLE - 1 AS tokens FROM o WHERE k = 1
          UNION ALL SELECT o.user_id, o.event_id, o.t, o.k, least({CAPACITY}::DOUBLE, tokens + (o.t - b.t) / 1e6::DOUBLE * {RATE!r}::DOUBLE) >= 1,
            least({CAPACITY}::DOUBLE, tokens + (o.t - b.t) / 1e6::DOUBLE * {RATE!r}::DOUBLE) - CASE WHEN least({CAPACITY}::DOUBLE, tokens + (o.t - b.t) / 1e6::DOUBLE * {RATE!r}::DOUBLE) >= 1 THEN 1 ELSE 0 END
          FROM b JOIN o ON o.user_id = b.user_id AND o.k = b.k + 1)
        SELECT user_id, event_id, allowed, round(tokens, 6) AS tokens FROM b""",
    "idempotency_replay": f"""
        WITH RECURSIVE o AS (SELECT user_id, event_type, event_id, event_id % 2 AS d, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL),
        b AS (SELECT user_id, event_type, event_id, k, t AS rt, d AS rd, 'fresh' AS outcome FROM o WHERE k = 1
          UNION ALL SELECT o.user_id, o.event_type, o.event_id, o.k, CASE WHEN o.t - rt >= {TTL}000000 THEN o.t ELSE rt END, CASE WHEN o.t - rt >= {TTL}000000 THEN o.d ELSE rd END,
            CASE WHEN o.t - rt >= {TTL}000000 THEN 'fresh' WHEN rd IS NOT DISTINCT FROM o.d THEN 'replay' ELSE 'conflict' END
          FROM b JOIN o ON o.user_id = b.user_id AND o.event_type = b.event_type AND o.k = b.k + 1)
        SELECT user_id, event_type, event_id, outcome FROM b""",
    "running_budget": f"""WITH {_R}, s AS (SELECT workspace_id, request_id, sum(coalesce(total_tokens, 0)) OVER (PARTITION BY workspace_id ORDER BY created_at, request_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM r WHERE workspace_id IS NOT NULL AND created_at IS NOT NULL)
        SELECT *, spent <= 10000 AS within FROM s""",
    "retry_delays": "SELECT execution_status, a::INT AS attempt, pow(2.0::DOUBLE, a - 1) AS delay FROM (SELECT DISTINCT execution_status FROM runs WHERE execution_status LIKE '%error' OR execution_status = 'timeout'), range(1, 5) t(a)",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
