"""Queries of order-dependent operators and of aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import lines, metrics
from . import query
from .scalars import _t


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tracks: each user's values in time order are heights."""
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.round("value", 2).alias("value")))), lambda e: e["value"]).alias("z"))


@query(
    "climb",
    """WITH t AS (SELECT user_id, list(round(value, 2) ORDER BY ts, event_id) AS z FROM events GROUP BY user_id),
h AS (SELECT user_id, z, list_reduce(z[2:], lambda a, v: CASE WHEN v > a.l + 10 THEN {'l': v, 'u': a.u + (v - a.l), 'd': a.d} WHEN v < a.l - 10 THEN {'l': v, 'u': a.u, 'd': a.d + (a.l - v)} ELSE a END, {'l': z[1], 'u': 0e0, 'd': 0e0}) AS h FROM t WHERE len(z) >= 2)
SELECT user_id, round(h.u + greatest(z[-1] - z[1] - (h.u - h.d), 0), 4) AS up, round(h.d + greatest(-(z[-1] - z[1] - (h.u - h.d)), 0), 4) AS down FROM h
UNION ALL SELECT user_id, 0e0, 0e0 FROM t WHERE len(z) < 2""",
)
def climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ascent and descent of each track with a dead band of ten."""
    t = _tracks(spark, sf_dir).withColumn("c", geo.climb("z", 10))
    return t.select("user_id", F.round("c.up", 4).alias("up"), F.round("c.down", 4).alias("down"))


@query(
    "cumulative_length",
    """SELECT event_id, round(sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS along
FROM (SELECT event_id, user_id, ts, coalesce(abs(round(value, 2) - lag(round(value, 2)) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0) AS step FROM events)""",
)
def cumulative_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("v", F.round("value", 2))
    step = F.coalesce(F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))), F.lit(0.0))
    return e.withColumn("step", step).select("event_id", F.round(lines.running(F.col("step"), ["user_id"], ["ts", "event_id"]), 4).alias("along"))


@query(
    "merged_steps",
    """WITH n AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT user_id, CAST(island AS BIGINT) AS island, any_value(event_type) AS name, count(*) AS steps, round(sum(round(value, 2)), 4) AS meters FROM i GROUP BY user_id, island""",
)
def merged_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of the same type, as one step."""
    i = lines.islands(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return i.groupBy("user_id", "island").agg(F.first("event_type").alias("name"), F.count("*").alias("steps"), F.round(F.sum(F.round("value", 2)), 4).alias("meters"))


@query("folded_steps")
def folded_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same steps with the short ones folded into their neighbours."""
    steps = merged_steps(spark, sf_dir).withColumn("mode", F.lit("hike"))
    rows = steps.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("island", "name", "mode", "meters", F.col("steps").cast("double").alias("seconds")))).alias("s"))
    rows = rows.select("id", F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["mode"].alias("mode"), x["meters"].alias("meters"), x["seconds"].alias("seconds"))).alias("steps"))
    return lines.folded(rows).select("id", F.size("steps").alias("n"), F.round(F.expr("aggregate(steps, 0D, (a, s) -> a + s.meters)"), 2).alias("meters"))


@query(
    "profile_samples",
    """WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, round(value, 2) AS z FROM events),
s AS (SELECT user_id, unnest(range(0, CAST(floor((count(*) - 1) * 30 / 50e0) AS BIGINT) + 1)) * 50e0 AS d, (count(*) - 1) * 30e0 AS total FROM p GROUP BY user_id),
q AS (SELECT user_id, d FROM s UNION ALL SELECT user_id, total FROM s GROUP BY user_id, total HAVING total - max(d) > 1)
SELECT q.user_id, q.d, round(a.z + (coalesce(b.z, a.z) - a.z) * (q.d / 30 - floor(q.d / 30)), 4) AS z
FROM q JOIN p a ON a.user_id = q.user_id AND a.i = CAST(floor(q.d / 30) AS BIGINT) LEFT JOIN p b ON b.user_id = q.user_id AND b.i = a.i + 1""",
)
def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights every 50 m along tracks whose points are 30 m apart."""
    t = _tracks(spark, sf_dir).withColumn("cum", F.expr("transform(z, (v, i) -> i * 30D)"))
    return t.select("user_id", F.inline(lines.profile("cum", "z", 50.0))).select("user_id", "d", F.round("z", 4).alias("z"))


@query(
    "latency_histogram",
    """WITH b AS (SELECT unnest([.01, .025, .05, .1, .25, .5, 1, 2, 5, 15, 1e300]::DOUBLE[]) AS le)
SELECT event_type, CASE WHEN le > 1e200 THEN '+Inf' ELSE CAST(round(le * 1000) AS BIGINT) || ' ms' END AS bucket, count(*) FILTER (v <= le) AS n
FROM (SELECT event_type, value / 10 AS v FROM events), b GROUP BY event_type, le""",
)
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative buckets of each type's latencies."""
    rows = _t(spark, sf_dir, "events").select("event_type", (F.col("value") / 10).alias("v"))
    return metrics.histogram(rows, "event_type", "v")


@query(
    "percentiles",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (k = greatest(ceil(.5 * n), 1)) AS p50, max(value) FILTER (k = greatest(ceil(.9 * n), 1)) AS p90, max(value) FILTER (k = greatest(ceil(.99 * n), 1)) AS p99,
  min(value) AS least, max(value) AS most FROM r GROUP BY event_type""",
)
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles, exact, without putting a group into one task."""
    return metrics.nearest_rank(_t(spark, sf_dir, "events"), "event_type", "value", (50, 90, 99))


@query(
    "step_overlap",
    """WITH s AS (SELECT user_id, list_distinct(list(event_type || event_id % 7)) AS a FROM events GROUP BY user_id)
SELECT x.user_id, CAST(len(list_intersect(x.a, y.a)) AS INTEGER) AS shared, round(len(list_intersect(x.a, y.a)) / len(list_distinct(list_concat(x.a, y.a))), 6) AS jaccard FROM s x JOIN s y ON y.user_id = x.user_id + 1""",
)
def step_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the steps of neighbouring users' tracks have in common."""
    s = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.concat("event_type", (F.col("event_id") % 7).cast("string"))).alias("a"))
    both = s.join(s.select((F.col("user_id") - 1).alias("user_id"), F.col("a").alias("b")), "user_id")
    shared = F.size(F.array_intersect("a", "b"))
    return both.select("user_id", shared.alias("shared"), F.round(shared / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


@query(
    "glyph_blocks",
    """SELECT CAST(ord(c) // 256 AS BIGINT) AS block, count(*) AS n, count(DISTINCT c) AS glyphs FROM (SELECT unnest(string_split(text, '')) AS c FROM benchmark) WHERE c <> '' GROUP BY 1""",
)
def glyph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which blocks of 256 code points texts need."""
    return metrics.glyph_blocks(_t(spark, sf_dir, "benchmark"), "text")


@query(
    "extents",
    """SELECT s_nationkey, min(s_suppkey * 337 % 11000) AS min_x, max(s_suppkey * 337 % 11000) AS max_x, min(s_suppkey * 911 % 12000) AS min_y, max(s_suppkey * 911 % 12000) AS max_y, count(*) AS n FROM supplier GROUP BY s_nationkey""",
)
def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_suppkey") * 337 % 11000).alias("x"), (F.col("s_suppkey") * 911 % 12000).alias("y"))
    return s.groupBy("s_nationkey").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.count("*").alias("n"))


@query(
    "approach_sets",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity * 100 AS m, coalesce(sum(l_quantity * 100) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM lineitem)
SELECT l_orderkey, count(*) AS stretches, sum(m) AS meters FROM r WHERE after < 3000 GROUP BY l_orderkey""",
)
def approach_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three kilometres of each walk, counted from its end."""
    after = F.coalesce(F.sum("m").over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber"), F.desc("l_partkey"), F.desc("l_quantity")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = _t(spark, sf_dir, "lineitem").withColumn("m", F.col("l_quantity") * 100).withColumn("after", after)
    return rows.filter("after < 3000").groupBy("l_orderkey").agg(F.count("*").alias("stretches"), F.sum("m").alias("meters"))


@query(
    "log_cap",
    """WITH r AS (SELECT *, date_trunc('hour', ts) AS s, event_type = 'error' AS e FROM events),
k AS (SELECT *, CASE WHEN NOT e THEN row_number() OVER (PARTITION BY s, e ORDER BY ts, event_id) END AS n FROM r),
d AS (SELECT s, count(*) FILTER (n > 5) AS dropped FROM k GROUP BY s)
SELECT s, CAST(count(*) FILTER (e OR n <= 5) AS BIGINT) AS written, CAST(any_value(coalesce(dropped, 0)) AS BIGINT) AS dropped FROM k JOIN d USING (s) GROUP BY s""",
)
def log_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five lines an hour, errors besides, and how many were dropped."""
    rows = _t(spark, sf_dir, "events").withColumn("s", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return metrics.capped(rows, "s", ["ts", "event_id"], F.col("event_type") == "error", 5).groupBy("s").agg(F.sum(F.col("kept").cast("long")).alias("written"), F.sum((~F.col("kept")).cast("long")).alias("dropped"))
