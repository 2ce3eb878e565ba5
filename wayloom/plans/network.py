"""Queries on the lattice region: edges, weights, degrees, components, cores, distances, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import access
from ..operators import graph, region, routing
from ..operators.snap import nearest
from . import query

#: The lattice as SQL: nodes, and stretches of both kinds of region.
LATTICE = """
WITH RECURSIVE g AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM customer),
nodes AS (SELECT c_custkey AS node, c_custkey % w AS ix, c_custkey // w AS iy, c_acctbal / 10 AS z, c_mktsegment, c_nationkey, n, w FROM customer, g),
ends AS (
  SELECT node * 2 AS st, node AS a, node + 1 AS b, CASE WHEN iy % 4 = 0 THEN 'primary' WHEN (ix + iy) % 3 = 0 THEN 'path' ELSE 'track' END AS grid_cls, z AS za, c_mktsegment, c_nationkey
  FROM nodes WHERE ix + 1 < w AND node + 1 < n
  UNION ALL
  SELECT node * 2 + 1, node, node + w, CASE WHEN ix % 4 = 0 THEN 'primary' WHEN (ix + iy) % 3 = 0 THEN 'path' ELSE 'track' END, z, c_mktsegment, c_nationkey
  FROM nodes WHERE node + w < n),
st AS (
  SELECT st, a, b, grid_cls, 1000e0 AS len, greatest(nodes.z - za, 0) AS up, greatest(za - nodes.z, 0) AS down, st % 5 - 1 AS mtb,
    CASE ends.c_mktsegment WHEN 'AUTOMOBILE' THEN 'primary' WHEN 'BUILDING' THEN 'residential' WHEN 'FURNITURE' THEN 'service' WHEN 'HOUSEHOLD' THEN 'path' ELSE 'track' END AS seg_cls,
    ends.c_nationkey % 5 = 0 AS one_way FROM ends JOIN nodes ON nodes.node = b)
"""
_CAR_SEGMENTS = """
, car AS (
  SELECT a AS src, b AS dst, st FROM st WHERE seg_cls IN ('primary', 'residential', 'service')
  UNION ALL SELECT b, a, st FROM st WHERE seg_cls IN ('primary', 'residential', 'service') AND NOT one_way)
"""


def _broken(spark: SparkSession, sf_dir: str) -> region.Region:
    return region.load(spark, sf_dir, structural=False)


def _car(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region.directed(_broken(spark, sf_dir).stretches, "car")


@query(
    "edge_weights",
    LATTICE
    + """
, d AS (SELECT st, a AS src, b AS dst, up, down, grid_cls, mtb, len FROM st UNION ALL SELECT st, b, a, down, up, grid_cls, mtb, len FROM st),
w AS (
  SELECT st, src, dst, 'car' AS mode, len / CASE grid_cls WHEN 'primary' THEN 16.6e0 ELSE 13.9e0 END AS w FROM d WHERE grid_cls = 'primary'
  UNION ALL
  SELECT st, src, dst, 'bike', (CASE grid_cls WHEN 'primary' THEN 1.6e0 ELSE 1e0 END) * (CASE WHEN st % 3 = 0 THEN 1e0 ELSE 1.05e0 END) * len / (v / 3.6e0)
  FROM (SELECT *, CASE WHEN s > 0 THEN base / (1 + 12 * s) WHEN s < 0 THEN least(base * (1 - 3 * s), 40) ELSE base END AS v
    FROM (SELECT *, greatest(-0.3, least(0.3, (up - down) / len)) AS s, CASE grid_cls WHEN 'primary' THEN 15.0 WHEN 'track' THEN 12.0 ELSE 8.0 END AS base FROM d
      WHERE grid_cls = 'primary' OR (grid_cls = 'track' AND mtb <= 2) OR (grid_cls = 'path' AND mtb BETWEEN 0 AND 1)))
  UNION ALL
  SELECT st, src, dst, 'hike', (greatest(h, v) + least(h, v) / 2) * (CASE WHEN st % 2 = 0 THEN 0.9 WHEN grid_cls = 'primary' THEN 1.5 ELSE 1.2 END)
    * (CASE WHEN grid_cls = 'path' AND st % 6 + 1 = 5 THEN 1.6 WHEN grid_cls = 'path' AND st % 6 + 1 = 6 THEN 2.0 ELSE 1.0 END)
  FROM (SELECT *, len / (4000e0 / 3600) AS h, up / (400e0 / 3600) + down / (800e0 / 3600) AS v FROM d))
SELECT st, src, dst, mode, round(w + 1e-6, 2) AS seconds FROM w
""",
)
def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who may use each stretch and what it costs in each direction."""
    stretches = region.load(spark, sf_dir).stretches
    parts = []
    for mode in access.MODES:
        own = stretches.filter(access.usable(mode))
        for a, b, rev in (("a", "b", False), ("b", "a", True)):
            parts.append(own.select("st", F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(mode).alias("mode"), F.round(access.weight(mode, rev) + 1e-6, 2).alias("seconds")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(
    "node_degrees",
    LATTICE
    + _CAR_SEGMENTS
    + """SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM car UNION ALL SELECT dst, 0, 1 FROM car) GROUP BY node""",
)
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = _car(spark, sf_dir).select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


@query(
    "components",
    LATTICE
    + _CAR_SEGMENTS
    + """, both_ways AS (SELECT src, dst FROM car UNION SELECT dst, src FROM car),
r AS (SELECT src AS node, src AS seen FROM both_ways UNION SELECT r.node, e.dst FROM r JOIN both_ways e ON r.seen = e.src)
SELECT node, min(seen) AS component FROM r GROUP BY node""",
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak components of the fragmented road network, named by their least node."""
    return graph.components(_car(spark, sf_dir))


@query(
    "component_sizes",
    LATTICE
    + _CAR_SEGMENTS
    + """, both_ways AS (SELECT src, dst FROM car UNION SELECT dst, src FROM car),
r AS (SELECT src AS node, src AS seen FROM both_ways UNION SELECT r.node, e.dst FROM r JOIN both_ways e ON r.seen = e.src),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT component, count(*) AS nodes, count(*) = max(count(*)) OVER () AS largest FROM c GROUP BY component""",
)
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = graph.components(_car(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("nodes"))
    return sizes.crossJoin(F.broadcast(sizes.agg(F.max("nodes").alias("most")))).select("component", "nodes", (F.col("nodes") == F.col("most")).alias("largest"))


_ONE_WAY = """, e2 AS (SELECT a AS src, b AS dst, st FROM st UNION ALL SELECT b, a, st FROM st WHERE st % 7 <> 0)
"""


def _half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice with every seventh stretch one-way."""
    e = region.directed(region.load(spark, sf_dir).stretches, "hike")
    return e.filter("not rev or st % 7 <> 0").select("src", "dst", "st")


@query(
    "hub_core",
    LATTICE
    + _ONE_WAY
    + """, w AS (SELECT src, dst FROM e2 UNION SELECT dst, src FROM e2),
r AS (SELECT src AS node, src AS seen FROM w UNION SELECT r.node, w.dst FROM r JOIN w ON r.seen = w.src),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node),
m AS (SELECT component, count(*) AS size FROM c GROUP BY component ORDER BY size DESC, component LIMIT 1),
h AS (SELECT node FROM c JOIN m USING (component) LEFT JOIN (SELECT src AS node, count(*) AS degree FROM e2 GROUP BY src) USING (node) ORDER BY coalesce(degree, 0) DESC, node LIMIT 1),
f AS (SELECT node FROM h UNION SELECT dst FROM f JOIN e2 ON src = node),
b AS (SELECT node FROM h UNION SELECT src FROM b JOIN e2 ON dst = node),
k AS (SELECT node FROM f JOIN b USING (node))
SELECT node FROM k WHERE 4 * (SELECT count(*) FROM k) >= (SELECT size FROM m)""",
)
def hub_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a half-open network that can go to its hub and back."""
    return graph.hub_core(_half_open(spark, sf_dir))


@query(
    "dense_ids",
    LATTICE + "SELECT node, row_number() OVER (ORDER BY p) - 1 AS id FROM (SELECT node, min(p) AS p FROM (SELECT a AS node, st * 2 AS p FROM st UNION ALL SELECT b, st * 2 + 1 FROM st) GROUP BY node)",
)
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region.dense_ids(region.load(spark, sf_dir).stretches)


@query(
    "junctions",
    LATTICE + "SELECT node, count(*) AS touched FROM (SELECT a AS node FROM st UNION ALL SELECT b FROM st) GROUP BY node HAVING count(*) > 2",
)
def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that more than two stretches touch."""
    st = region.load(spark, sf_dir).stretches
    return st.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("touched")).filter("touched > 2")


_DECI = "CAST(round(10 * (greatest(h, v) + least(h, v) / 2)) AS BIGINT)"


def _walk_deciseconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole deciseconds of plain walking on every stretch, both ways: sums are exact."""
    st = region.load(spark, sf_dir).stretches
    h, parts = F.col("len") / access.WALK_FLAT, []
    for a, b, up, down in (("a", "b", "up", "down"), ("b", "a", "down", "up")):
        v = F.col(up) / access.WALK_UP + F.col(down) / access.WALK_DOWN
        parts.append(st.select(F.col(a).alias("src"), F.col(b).alias("dst"), "st", F.round(10 * (F.greatest(h, v) + F.least(h, v) / 2)).cast("double").alias("w")))
    return parts[0].union(parts[1])


@query(
    "distances_from_origin",
    LATTICE
    + f""", e AS (
  SELECT a AS src, b AS dst, {_DECI} AS w FROM (SELECT *, len / (4000e0 / 3600) AS h, up / (400e0 / 3600) + down / (800e0 / 3600) AS v FROM st)
  UNION ALL SELECT b, a, {_DECI} FROM (SELECT *, len / (4000e0 / 3600) AS h, down / (400e0 / 3600) + up / (800e0 / 3600) AS v FROM st)),
t(node, dist) USING KEY (node) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION
  SELECT e.dst, min(t.dist + e.w) FROM t JOIN e ON e.src = t.node LEFT JOIN recurring.t r ON r.node = e.dst WHERE r.dist IS NULL OR t.dist + e.w < r.dist GROUP BY e.dst)
SELECT node, dist AS deciseconds FROM t""",
)
def distances_from_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walking time from node 0 to every node."""
    found = graph.distances(_walk_deciseconds(spark, sf_dir), spark.createDataFrame([(0,)], "source long"))
    return found.select("node", F.col("dist").cast("long").alias("deciseconds"))


@query(
    "distances_by_rounds",
    LATTICE
    + """, car AS (SELECT a AS src, b AS dst FROM st WHERE seg_cls = 'residential' UNION ALL SELECT b, a FROM st WHERE seg_cls = 'residential' AND NOT one_way),
both_ways AS (SELECT src, dst FROM car UNION SELECT dst, src FROM car),
r AS (SELECT src AS node, src AS seen FROM both_ways UNION SELECT r.node, e.dst FROM r JOIN both_ways e ON r.seen = e.src),
s AS (SELECT DISTINCT min(seen) AS source FROM r GROUP BY node),
t(source, node, hops) USING KEY (source, node) AS (
  SELECT source, source, CAST(0 AS BIGINT) FROM s
  UNION
  SELECT t.source, car.dst, min(t.hops + 1) FROM t JOIN car ON car.src = t.node LEFT JOIN recurring.t r ON r.source = t.source AND r.node = car.dst WHERE r.hops IS NULL OR t.hops + 1 < r.hops GROUP BY t.source, car.dst)
SELECT source, node, hops FROM t""",
)
def distances_by_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches from the least node of each piece of the residential network, by rounds of joins: the way beyond a broadcast's bound."""
    car = region.directed(_broken(spark, sf_dir).stretches.filter("cls = 'residential'"), "car")
    sources = graph.components(car).select(F.col("component").alias("source")).distinct().withColumn("node", F.col("source"))
    found = graph.relax(car.withColumn("w", F.lit(1.0)), sources)
    return found.select("source", "node", F.col("dist").cast("long").alias("hops"))


@query(
    "within_hops",
    LATTICE
    + _CAR_SEGMENTS
    + """, h AS (SELECT DISTINCT src AS start, src AS node, 0 AS hop FROM car UNION SELECT h.start, car.dst, hop + 1 FROM h JOIN car ON car.src = h.node WHERE hop < 3)
SELECT start, count(DISTINCT node) AS reached FROM h GROUP BY start""",
)
def within_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes lie within three stretches of each node of the road network."""
    e = _car(spark, sf_dir)
    return graph.within_hops(e, e.select("src").distinct(), 3).groupBy("start").agg(F.count("*").alias("reached"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points on the lattice's plane."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("pid"), (F.col("s_suppkey") * 337 % 11000 + F.col("s_acctbal") / 100).alias("px"), (F.col("s_suppkey") * 911 % 12000 - F.col("s_acctbal") / 100).alias("py")
    )


@query(
    "snap_nearest",
    LATTICE
    + """, p AS (SELECT s_suppkey AS pid, s_suppkey * 337 % 11000 + s_acctbal / 100 AS px, s_suppkey * 911 % 12000 - s_acctbal / 100 AS py FROM supplier),
d AS (SELECT pid, node, sqrt(pow(px - ix * 1000.0, 2) + pow(py - iy * 1000.0, 2)) AS dist, iy % 4 = 0 AND NOT (sqrt(pow(px - ix * 1000.0, 2) + pow(py - iy * 1000.0, 2)) > 600) AS street FROM p, nodes),
r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY NOT street, dist, node) AS k FROM d WHERE dist <= 1000)
SELECT p.pid, r.node AS tid, round(r.dist, 4) AS dist FROM p LEFT JOIN r ON r.pid = p.pid AND k = 1""",
)
def snap_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest node within a kilometre; one on a street wins if within 600 m."""
    t = region.load(spark, sf_dir).nodes.select(F.col("node").alias("tid"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    found = nearest(_places(spark, sf_dir), t, 1000.0, prefer=(F.col("ty") / 1000) % 4 == 0, prefer_within=600.0)
    return found.select("pid", "tid", F.round("dist", 4).alias("dist"))


def _requests(spark: SparkSession, sf_dir: str, mode: str, alternatives: int) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").agg(F.count("*").alias("n"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").crossJoin(F.broadcast(n))
    stops = F.array((F.col("s_suppkey") * 7919) % F.col("n"), (F.col("s_suppkey") * 104729 + 17) % F.col("n"))
    return s.select(F.col("s_suppkey").alias("id"), stops.alias("stops"), F.lit(mode).alias("mode"), F.lit(5).alias("grade"), F.lit(alternatives).alias("alternatives"), F.array().cast("array<long>").alias("avoid"))


@query(
    "route_batch",
    LATTICE
    + """, d AS (SELECT st, a AS src, b AS dst, up, down, grid_cls, len FROM st UNION ALL SELECT st, b, a, down, up, grid_cls, len FROM st),
e AS (SELECT src, dst, len, CAST(CAST((greatest(h, v) + least(h, v) / 2) * (CASE WHEN st % 2 = 0 THEN 0.9e0 WHEN grid_cls = 'primary' THEN 1.5e0 ELSE 1.2e0 END)
    * (CASE WHEN grid_cls = 'path' AND st % 6 + 1 = 5 THEN 1.6e0 WHEN grid_cls = 'path' AND st % 6 + 1 = 6 THEN 2e0 ELSE 1e0 END) AS FLOAT) AS DOUBLE) AS w
  FROM (SELECT *, len / (4000e0 / 3600) AS h, up / (400e0 / 3600) + down / (800e0 / 3600) AS v FROM d)),
q AS (SELECT s_suppkey AS id, s_suppkey * 7919 % n AS a, (s_suppkey * 104729 + 17) % n AS b FROM supplier, g),
t(source, node, dist, meters) USING KEY (source, node) AS (
  SELECT DISTINCT a, a, 0e0, 0e0 FROM q
  UNION
  SELECT t.source, e.dst, min(t.dist + e.w), arg_min(t.meters + e.len, t.dist + e.w) FROM t JOIN e ON e.src = t.node LEFT JOIN recurring.t r ON r.source = t.source AND r.node = e.dst
  WHERE r.dist IS NULL OR t.dist + e.w < r.dist - 1e-9 GROUP BY t.source, e.dst)
SELECT id, '' AS reason, CAST(1 AS INTEGER) AS n_routes, round(dist + 1e-6, 1) AS seconds, meters FROM q JOIN t ON source = a AND node = b""",
)
def route_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walking routes for a batch of requests, one row each."""
    found = routing.route(region.load(spark, sf_dir), _requests(spark, sf_dir, "hike", 1))
    best = F.col("routes")[0]
    return found.select("id", "reason", F.size("routes").alias("n_routes"), F.round(best["seconds"] + 1e-6, 1).alias("seconds"), best["meters"].alias("meters"))


@query("route_steps")
def route_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named steps of the same routes."""
    found = routing.route(region.load(spark, sf_dir), _requests(spark, sf_dir, "hike", 1))
    r = found.select("id", F.posexplode(F.col("routes")[0]["steps"]).alias("step", "s"))
    return r.select("id", "step", "s.name", "s.mode", "s.meters", F.round("s.seconds", 1).alias("seconds"))


@query("route_alternatives")
def route_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three distinct car-and-walk routes for each request."""
    found = routing.route(region.load(spark, sf_dir), _requests(spark, sf_dir, "car+hike", 3))
    r = found.select("id", "reason", F.posexplode_outer("routes").alias("rank", "r"))
    return r.select("id", "reason", "rank", F.round("r.seconds", 1).alias("seconds"), F.size("r.legs").alias("n_legs"))
