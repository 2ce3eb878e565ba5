"""Queries of the request stream's state, over events: users are keys, types are what was asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import state
from . import query
from .scalars import _t


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query(
    "dedup_window",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch(ts)) AS k FROM events),
r AS (
  SELECT event_id, user_id, event_type, k, t AS anchor, true AS kept FROM e WHERE k = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.event_type, e.k, CASE WHEN e.t - r.anchor > 36000 THEN e.t ELSE r.anchor END, e.t - r.anchor > 36000 FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.k = r.k + 1)
SELECT event_id FROM r WHERE kept""",
)
def dedup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are not within ten hours of the user's last of the type that was let through."""
    return state.dedup_window(_events(spark, sf_dir), ["user_id", "event_type"], "at", 36000).select("event_id")


@query("rate_limits")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests a minute and three an hour for each event type: who is let in, and when to come again."""
    found = state.over_batch(_events(spark, sf_dir), "event_type", ["at", "event_id"], state.limiter(2, 3), "allowed boolean, retry_after int", ["at"])
    return found.select("event_id", "allowed", "retry_after")


@query(
    "refusal_cache",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS k FROM events),
r AS (
  SELECT event_id, user_id, k, t AS fresh, false AS cached FROM e WHERE k = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.k, CASE WHEN e.t - r.fresh < 36000 THEN r.fresh ELSE e.t END, e.t - r.fresh < 36000 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id, cached FROM r""",
)
def refusal_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a cache of ten hours, counted from the last fresh answer, would have answered."""
    return state.over_batch(_events(spark, sf_dir), "user_id", ["at", "event_id"], state.refusal_cache(36000), "cached boolean", ["at"]).select("event_id", "cached")


@query(
    "broker_health",
    """WITH e AS (SELECT event_id, user_id, ts, event_type <> 'error' AS ok FROM events),
g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS good FROM e),
n AS (SELECT event_id, CASE WHEN ok THEN 0 ELSE sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, good ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS n FROM g)
SELECT event_id, n > 0 AS degraded, CAST(CASE WHEN n = 0 THEN 0 ELSE 5 * pow(2, least(n - 1, 4)) END AS INTEGER) AS wait FROM n""",
)
def broker_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits after failures in a row: 5, 10, 20, 40, 80 seconds."""
    e = _events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error")
    return state.over_batch(e, "user_id", ["at", "event_id"], state.backoff(), "degraded boolean, wait int", ["ok"]).select("event_id", "degraded", "wait")


@query(
    "folded_history",
    """WITH n AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w AND epoch(ts) - lag(epoch(ts)) OVER w BETWEEN 0 AND 36000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts), event_id)),
e AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id ROWS UNBOUNDED PRECEDING) AS entry FROM n)
SELECT user_id, CAST(entry AS BIGINT) AS entry, any_value(event_type) AS question, count(*) AS asked, max(event_id) AS last_id FROM e GROUP BY user_id, entry""",
)
def folded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History entries: the same question again within ten hours updates the last entry."""
    f = state.fold_history(_events(spark, sf_dir), "user_id", "event_type", "at", "event_id", 36000)
    return f.groupBy("user_id", "entry").agg(F.first("event_type").alias("question"), F.count("*").alias("asked"), F.max("event_id").alias("last_id"))


@query(
    "newest_items",
    """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER w AS n, sum(length(o_orderpriority) * 10) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS b
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC))
SELECT o_orderkey, o_custkey FROM r WHERE n <= 8 AND (n = 1 OR b <= 400)""",
)
def newest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's newest orders: eight at most, then as many as fit into 400 bytes."""
    o = _t(spark, sf_dir, "orders").withColumn("size", F.length("o_orderpriority") * 10)
    return state.newest(o, "o_custkey", "o_orderdate", "o_orderkey", "size", 8, 400).select("o_orderkey", "o_custkey")


@query(
    "answered_requests",
    """SELECT a.event_id AS id, coalesce(b.event_id, -1) AS reply FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 1 AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR""",
)
def answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a reply that came in time: the next event stands for it."""
    e = _t(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    replies = e.select((F.col("event_id") - 1).alias("id"), "at", F.col("event_id").alias("reply"))
    return state.answered(e.select(F.col("event_id").alias("id"), "at"), replies, 6 * 3600).select("id", F.coalesce(F.col("reply").cast("long"), F.lit(-1)).alias("reply"))


@query(
    "counter_deltas",
    """SELECT event_id, CASE WHEN d >= 0 THEN round(d, 4) ELSE -1 END AS delta FROM (SELECT event_id, coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS d FROM events)""",
)
def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of a sampled counter; -1 where it began again."""
    from pyspark.sql import Window

    d = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _t(spark, sf_dir, "events").select("event_id", F.when(d >= 0, F.round(d, 4)).otherwise(F.lit(-1.0)).alias("delta"))
