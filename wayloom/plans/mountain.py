"""Queries of lifts, progress along routes, keys and codecs, rings, and trails by their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import catalogue, lifts, progress, region, rings
from ..sources import exposition
from . import query
from .network import LATTICE, _places
from .scalars import _t

#: Lifts over the lattice: two rows down and two columns right of every second node, both stations off the paths.
_LIFTS = """, n2 AS (SELECT node, ix * 1000e0 AS x, iy * 1000e0 AS y, z, n, w FROM nodes),
sn AS (SELECT node + 1000000000 AS node, x + 30e0 + node % 3 * 40 AS x, y + 40e0 AS y, z + node % 11 - 5 AS z FROM n2 WHERE node % 2 = 0),
lf AS (SELECT node // 2 AS st, node + 1000000000 AS a, node + 2 * w + 2 + 1000000000 AS b, CASE node % 5 WHEN 0 THEN 'gondola' WHEN 1 THEN 'chair_lift' WHEN 2 THEN 'cable_car' ELSE 'mixed_lift' END AS kind,
  CASE WHEN node % 3 = 0 THEN 0e0 ELSE 400e0 + node % 100 END AS published, node % 4 = 0 AS uphill, sqrt(8e0) * 1000 AS len FROM n2 WHERE node % 2 = 0 AND node + 2 * w + 2 < n AND (node + 2 * w + 2) % 2 = 0),
e2 AS (SELECT lf.*, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS "by", q.z AS bz FROM lf JOIN sn p ON p.node = a JOIN sn q ON q.node = b)
"""
_STATION = 1_000_000_000


def _lifts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lifts, all nodes with the stations, and the walkable nodes."""
    nodes = region.load(spark, sf_dir).nodes
    size = F.broadcast(nodes.agg(F.count("*").alias("n"), F.ceil(F.sqrt(F.count("*"))).cast("long").alias("w")))
    k = F.col("node")
    stations = nodes.filter(k % 2 == 0).select((k + _STATION).alias("node"), (F.col("x") + 30.0 + k % 3 * 40).alias("x"), (F.col("y") + 40.0).alias("y"), (F.col("z") + k % 11 - 5).alias("z"))
    other = k + 2 * F.col("w") + 2
    kind = F.when(k % 5 == 0, "gondola").when(k % 5 == 1, "chair_lift").when(k % 5 == 2, "cable_car").otherwise("mixed_lift")
    table = nodes.crossJoin(size).filter((k % 2 == 0) & (other < F.col("n")) & (other % 2 == 0)).select(
        F.expr("node div 2").alias("st"), (k + _STATION).alias("a"), (other + _STATION).alias("b"), kind.alias("kind"), F.when(k % 3 == 0, 0.0).otherwise(400.0 + k % 100).alias("published"), (k % 4 == 0).alias("uphill"), F.lit(8.0**0.5 * 1000).alias("len")
    )
    return table, nodes.unionByName(stations), nodes


@query(
    "lift_rides",
    LATTICE
    + _LIFTS
    + """, r AS (SELECT *, coalesce(nullif(published, 0), len / CASE kind WHEN 'cable_car' THEN 10e0 WHEN 'gondola' THEN 5e0 WHEN 'chair_lift' THEN 2.5e0 ELSE 4e0 END) + 300 AS w, bz >= az AS rises FROM e2)
SELECT a AS src, b AS dst, st, round(w, 2) AS seconds, false AS rev FROM r WHERE NOT uphill OR rises UNION ALL SELECT b, a, st, round(w, 2), true FROM r WHERE NOT uphill OR NOT rises""",
)
def lift_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides of every lift, by its published duration or its kind's speed."""
    table, nodes, _ = _lifts(spark, sf_dir)
    return lifts.rides(table, nodes).select("src", "dst", "st", F.round(F.col("w").cast("double"), 2).alias("seconds"), "rev")


@query(
    "lift_links",
    LATTICE
    + _LIFTS
    + """, s AS (SELECT DISTINCT sn.* FROM sn JOIN lf ON node IN (a, b)),
d AS (SELECT s.node AS station, n2.node, sqrt(pow(s.x - n2.x, 2) + pow(s.y - n2.y, 2)) AS len, greatest(n2.z - s.z, 0) AS up, greatest(s.z - n2.z, 0) AS down FROM s JOIN n2 ON abs(s.x - n2.x) <= 100 AND abs(s.y - n2.y) <= 100),
b AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY len, node) AS k FROM d WHERE len <= 100),
w AS (SELECT *, len / (4000e0 / 3600) AS h, up / (400e0 / 3600) + down / (800e0 / 3600) AS v FROM b WHERE k = 1)
SELECT station, node, round(len, 4) AS len, round(1.2e0 * (greatest(h, v) + least(h, v) / 2), 1) AS seconds FROM w""",
)
def lift_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk from each station to the nearest junction of paths."""
    found = lifts.links(*_lifts(spark, sf_dir))
    return found.select("station", "node", F.round("len", 4).alias("len"), F.round(F.col("w").cast("double"), 1).alias("seconds"))


@query(
    "lift_chains",
    LATTICE
    + _LIFTS
    + """, s AS (SELECT st, CASE WHEN bz >= az THEN a ELSE b END AS low, least(az, bz) AS lz, CASE WHEN bz >= az THEN bx ELSE ax END AS hx, CASE WHEN bz >= az THEN "by" ELSE ay END AS hy FROM e2),
c AS (
  SELECT DISTINCT sn.node AS station, sn.node AS cur, x, y, z, 0 AS hop FROM sn JOIN lf ON node IN (a, b)
  UNION ALL
  SELECT station, low, sn.x, sn.y, sn.z, hop + 1 FROM (
    SELECT station, hop, arg_min(low, (lz, st)) AS low FROM c JOIN s ON sqrt(pow(hx - x, 2) + pow(hy - y, 2)) <= 250 AND lz < z WHERE hop < 8 GROUP BY station, hop) t JOIN sn ON sn.node = low)
SELECT station, coalesce(nullif(arg_max(cur, hop), station), -1) AS bottom FROM c GROUP BY station""",
)
def lift_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valley station of the chain of sections each station stands in; -1 for those that are the lowest."""
    table, nodes, _ = _lifts(spark, sf_dir)
    return lifts.chain_bottoms(table, nodes).select("station", F.coalesce("bottom", F.lit(-1)).alias("bottom"))


@query(
    "lift_near",
    LATTICE
    + _LIFTS
    + """, p AS (SELECT s_suppkey AS pid, s_suppkey * 337 % 11000 + s_acctbal / 100 AS px, s_suppkey * 911 % 12000 - s_acctbal / 100 AS py FROM supplier),
d AS (SELECT pid, st, sqrt(pow(px - (ax + t * (bx - ax)), 2) + pow(py - (ay + t * ("by" - ay)), 2)) AS dist FROM (
  SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * ("by" - ay)) / (pow(bx - ax, 2) + pow("by" - ay, 2)))) AS t FROM p, e2))
SELECT pid, arg_min(st, (dist, st)) AS st, round(min(dist), 4) AS dist FROM d WHERE dist <= 300 GROUP BY pid""",
)
def lift_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lift line within 300 m of each place."""
    table, nodes, _ = _lifts(spark, sf_dir)
    end = lambda c: nodes.select(F.col("node").alias(c), F.struct("x", "y").alias(f"p_{c}"))
    lines = table.join(end("a"), "a").join(end("b"), "b").select("st", F.array("p_a", "p_b").alias("line"))
    return lifts.lift_near(_places(spark, sf_dir), lines, 300.0).select("pid", "st", F.round("dist", 4).alias("dist"))


_PROFILE = """WITH s AS (SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS DOUBLE) * 100 AS m, round(o_totalprice) AS e, o_custkey % 13 * 64e0 AS along FROM orders),
t AS (SELECT *, lag(m) OVER w AS m0, lag(e) OVER w AS e0, count(*) OVER (PARTITION BY o_custkey) AS n, max(m) OVER (PARTITION BY o_custkey) AS total FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY m))
"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for each customer: their orders' prices as heights, 100 m apart."""
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.round("o_totalprice").alias("e")))).alias("s"))
    return o.select("o_custkey", F.transform("s", lambda p, i: F.struct((i * 100.0).alias("m"), p["e"].alias("e"))).alias("profile"), (F.col("o_custkey") % 13 * 64.0).alias("along"))


@query(
    "remaining_ascent",
    _PROFILE
    + """SELECT o_custkey, CASE WHEN any_value(n) >= 2 THEN round(coalesce(sum(greatest(0, e - CASE WHEN m0 IS NULL THEN e WHEN m0 <= along THEN e0 + (e - e0) * (along - m0) / (m - m0) ELSE e0 END)) FILTER (m > along), 0), 4) END AS ascent FROM t GROUP BY o_custkey""",
)
def remaining_ascent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The climb that is left from somewhere along each profile."""
    return _profiles(spark, sf_dir).select("o_custkey", F.round(progress.remaining_ascent("profile", "along"), 4).alias("ascent"))


@query(
    "route_progress",
    """WITH l AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_totalprice AS meters, o_orderkey % 1000 + 1e0 AS seconds FROM orders),
t AS (SELECT *, sum(meters) OVER (PARTITION BY o_custkey) AS whole, sum(meters) OVER (PARTITION BY o_custkey ORDER BY i) AS finish FROM l),
s AS (SELECT *, whole * 1.1e0 AS total, finish * 1.1e0 AS fin, (finish - meters) * 1.1e0 AS start, whole * (o_custkey % 17) / 15e0 AS along FROM t)
SELECT o_custkey, CAST(coalesce(min(i) FILTER (along < fin), max(i)) AS INTEGER) AS leg, round(sum(CASE WHEN along >= fin THEN 0 ELSE (fin - greatest(along, start)) / (fin - start) * seconds END), 3) AS seconds,
  CAST(CASE WHEN coalesce(min(i) FILTER (start > along), 0) = 0 THEN count(*) - 1 ELSE min(i) FILTER (start > along) END AS INTEGER) AS via FROM s GROUP BY o_custkey""",
)
def route_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leg, seconds left, and where a new point would go, from somewhere along routes a tenth longer than their legs."""
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.col("o_totalprice").alias("meters"), (F.col("o_orderkey") % 1000 + 1.0).alias("seconds")))).alias("legs"))
    o = o.withColumn("whole", F.expr("aggregate(legs, 0D, (a, l) -> a + l.meters)")).withColumn("total", F.col("whole") * 1.1).withColumn("along", F.col("whole") * (F.col("o_custkey") % 17) / 15.0)
    o = o.withColumn("ends", progress.leg_ends("legs", "total")).withColumn("starts", F.expr("transform(ends, (e, i) -> if(i = 0, 0D, ends[i - 1]))"))
    return o.select("o_custkey", progress.leg_at("ends", "along").alias("leg"), F.round(progress.remaining_seconds("legs", "ends", "along"), 3).alias("seconds"), progress.via_position("starts", "along").alias("via"))


@query(
    "thinned_profiles",
    """WITH s AS (SELECT user_id % 5 AS k, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id % 5) AS n FROM events)
SELECT k, i * 10e0 AS m FROM s WHERE i % greatest(1, n // 400) = 0 OR i = n - 1""",
)
def thinned_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of many samples, thinned for drawing."""
    e = _t(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("k")).agg(F.sort_array(F.collect_list("event_id")).alias("s"))
    p = e.select("k", F.transform("s", lambda x, i: F.struct((i * 10.0).alias("m"), x.alias("e"))).alias("p"))
    return p.select("k", F.explode(progress.thinned("p")).alias("x")).select("k", "x.m")


@query(
    "request_codecs",
    """WITH s AS (SELECT s_suppkey AS k, s_acctbal AS b FROM supplier),
t AS (SELECT k, b, 'no road within 1 km of ' || printf('%.5f', k / 8e0) || ', ' || printf('%.4f', k / -16e0) AS said FROM s)
SELECT k, CASE k % 2 WHEN 0 THEN 'car+hike' ELSE 'bike' END || '|' || CASE k % 3 WHEN 0 THEN '' ELSE 'EE' END || CASE WHEN k % 4 = 0 THEN '|lifts' ELSE '' END
    || '|' || printf('%.6f', 46 + k / 64e0) || ',' || printf('%.6f', 11 - k / 32e0) || CASE WHEN k % 5 = 0 THEN 'v' ELSE '' END || CASE WHEN k % 7 = 0 THEN '|x' || printf('%.6f', 46.5e0) || ',' || printf('%.6f', 11 + k / 16e0) ELSE '' END AS key,
  CASE WHEN k % 3 = 0 THEN k / 8e0 END AS far_lat, CASE WHEN k % 3 = 0 THEN k / -16e0 END AS far_lon,
  CASE k % 3 WHEN 0 THEN 'host' || k WHEN 1 THEN '[::1]' ELSE 'plain' END AS host, CAST(CASE WHEN k % 80 BETWEEN 1 AND 50 THEN k % 80 ELSE 10 END AS INTEGER) AS limit_,
  CASE WHEN greatest(abs(b / 100), k % 40) <= 15 THEN 'pass' WHEN greatest(abs(b / 100), k % 40) <= 30 THEN 'check' ELSE 'fail' END AS verdict FROM t""",
)
def request_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of requests, points named in refusals, hosts, limits and verdicts."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("b"))
    k, b = F.col("k"), F.col("b")
    points = F.array(F.struct((46 + k / 64).alias("lat"), (11 - k / 32).alias("lon"), (k % 5 == 0).alias("via")))
    avoid = F.when(k % 7 == 0, F.array(F.struct(F.lit(46.5).alias("lat"), (11 + k / 16).alias("lon")))).otherwise(F.array().cast("array<struct<lat:double,lon:double>>"))
    said = F.concat(F.lit("no road within 1 km of "), F.format_string("%.5f, %.4f", k / 8, k / -16))
    far = codecs.far_coordinate(F.when(k % 3 == 0, said).when(k % 3 == 1, F.lit("no route")))
    host = F.when(k % 3 == 0, F.concat(F.lit("host"), k.cast("string"), F.lit(":8080"))).when(k % 3 == 1, "[::1]").otherwise("plain")
    return s.select(
        "k", codecs.refusal_key(F.when(k % 2 == 0, "car+hike").otherwise("bike"), F.when(k % 3 == 0, "").otherwise("EE"), k % 4 == 0, points, avoid).alias("key"),
        far["lat"].alias("far_lat"), far["lon"].alias("far_lon"), codecs.host_only(host).alias("host"), codecs.clamped((k % 80).cast("int"), 50, 10).alias("limit_"), codecs.verdict(F.array(b / 100, (k % 40).cast("double"), F.lit(None).cast("double"))).alias("verdict"),
    )


@query(
    "metric_lines",
    """SELECT event_type AS name, CAST(count(*) AS DOUBLE) AS total, CAST(count(*) FILTER (user_id % 2 = 0) AS DOUBLE) AS even, 0e0 AS missing FROM events GROUP BY event_type""",
)
def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts written as metrics, one sample a line, and read back."""
    e = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("user_id") % 2 == 0, 1)).alias("even"))
    parity = {"type": F.col("event_type"), "parity": F.lit("even")}
    lines = F.array(F.lit("# TYPE events counter"), exposition.exposed("events", F.col("n"), {"type": F.col("event_type")}), exposition.exposed("events_even", F.col("even"), parity), F.lit("broken {"))
    text = e.select("event_type", F.posexplode(lines).alias("line_no", "value"))
    found = exposition.samples(text)
    one = lambda n, out, **labels: exposition.value_of(found, ["event_type"], n, labels).select(F.col("event_type").alias("name"), F.col("value").alias(out))
    return one("events", "total").join(one("events_even", "even", parity="even"), "name").join(one("events", "missing", parity="odd"), "name")


@query(
    "hole_rings",
    """WITH o AS (SELECT s_suppkey AS id, s_suppkey * 337 % 5000 AS x, s_suppkey * 911 % 5000 AS y, 200 + s_suppkey % 9 * 150 AS a FROM supplier),
h AS (SELECT p_partkey + 1000000 AS hole, p_partkey * 71 % 5200 + 0.5e0 AS x, p_partkey * 37 % 5200 + 0.5e0 AS y FROM part)
SELECT hole, coalesce(arg_min(id, (-a, id)), -1) AS outer_ FROM h LEFT JOIN o ON h.x > o.x AND h.x < o.x + a AND h.y > o.y AND h.y < o.y + a GROUP BY hole""",
)
def hole_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes and the largest area that holds each, -1 for none."""
    def square(k, x, y, a, inner):
        corners = [(x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y)]
        return [k.alias("id"), F.array(*[F.struct(p.cast("double").alias("x"), q.cast("double").alias("y")) for p, q in corners]).alias("ring"), F.lit(inner).alias("inner")]

    k, p = F.col("s_suppkey"), F.col("p_partkey")
    outer = _t(spark, sf_dir, "supplier").select(*square(k, k * 337 % 5000, k * 911 % 5000, 200 + k % 9 * 150, False))
    inner = _t(spark, sf_dir, "part").select(*square(p + 1_000_000, p * 71 % 5200 + 0.5, p * 37 % 5200 + 0.5, F.lit(5), True))
    return rings.assign_holes(outer.union(inner)).select("hole", F.coalesce("outer", F.lit(-1)).alias("outer_"))


@query(
    "trails_by_line",
    LATTICE
    + """, p AS (SELECT s_suppkey AS trail, s_suppkey % 40 AS no, s_suppkey * 337 % 38 * 1000e0 AS x, s_suppkey * 911 % 38 * 1000e0 + s_suppkey % 5 * 20 AS y, 2000e0 + s_suppkey % 7 * 1000 AS l FROM supplier),
s AS (SELECT st.st, st.st % 40 AS no, nodes.ix * 1000e0 AS x, nodes.iy * 1000e0 AS y FROM st JOIN nodes ON nodes.node = st.a),
d AS (SELECT st, trail, sqrt(pow(s.x + k * 100 - greatest(p.x, least(p.x + l, s.x + k * 100)), 2) + pow(s.y - p.y, 2)) AS d FROM s JOIN p USING (no), (SELECT unnest(range(0, 11)) AS k)),
f AS (SELECT st, trail, avg(CASE WHEN d <= 60 THEN 1e0 ELSE 0e0 END) AS part, median(d) AS med FROM d GROUP BY st, trail),
b AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY part DESC, med, trail) AS k FROM f)
SELECT st, trail, round(part, 4) AS part FROM b WHERE k = 1 AND part >= 0.8""",
)
def trails_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches joined to the trail of their number that most of their points lie on."""
    r = region.load(spark, sf_dir)
    points = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.struct((F.col("x") + i * 100.0).alias("x"), F.col("y").alias("y")))
    st = r.stretches.join(r.nodes, r.stretches["a"] == r.nodes["node"]).select("st", F.concat(F.lit("E"), (F.col("st") % 40).cast("string")).alias("number"), points.alias("points"))
    k = F.col("s_suppkey")
    x, y, length = k * 337 % 38 * 1000.0, k * 911 % 38 * 1000.0 + k % 5 * 20, 2000.0 + k % 7 * 1000
    line = F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + length).alias("x"), y.alias("y")))
    trails = _t(spark, sf_dir, "supplier").select(k.alias("trail"), F.lpad((k % 40).cast("string"), 4, "0").alias("number"), line.alias("line"))
    return catalogue.match_by_line(st, trails).select("st", "trail", F.round("part", 4).alias("part"))
