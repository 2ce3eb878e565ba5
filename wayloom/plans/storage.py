"""Queries of sources: elements, tile archives, rasters, masks, and region summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import access
from ..operators import catalogue, region
from ..sources import archive, elements, rasters
from . import query
from .network import LATTICE
from .scalars import _t


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as ways: brand and size give tags."""
    k = F.col("p_partkey")
    tags = F.map_filter(
        F.create_map(
            F.lit("highway"), F.element_at(F.array(*map(F.lit, ("primary", "footway", "", "", "construction", "steps", ""))), (k % 7 + 1).cast("int")),
            F.lit("aerialway"), F.when(k % 31 == 0, "gondola").otherwise(""),
            F.lit("landuse"), F.when(k % 7 == 2, "forest").when(k % 7 == 3, "vineyard").otherwise(""),
            F.lit("building"), F.when(k % 7 == 6, "yes").otherwise(""),
            F.lit("oneway"), F.when(k % 5 == 0, "-1").otherwise(""),
            F.lit("bicycle"), F.when(k % 4 == 0, "no").when(k % 4 == 1, "designated").otherwise(""),
            F.lit("sac_scale"), F.when(k % 9 == 0, "alpine_hiking").otherwise(""),
            F.lit("mtb:scale"), F.when(k % 6 == 0, "0").when(k % 6 == 1, "2+").otherwise(""),
            F.lit("name"), F.col("p_name"),
        ),
        lambda _, v: v != "",
    )
    return _t(spark, sf_dir, "part").select(k.alias("id"), tags.alias("tags"), F.array(k, k + 1, k + 2).alias("nodes"))


@query(
    "element_layers",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 31 = 0 THEN 'lift' WHEN p_partkey % 7 IN (0, 1, 5) THEN 'road' WHEN p_partkey % 7 = 2 THEN 'wood' WHEN p_partkey % 7 = 3 THEN 'farm' WHEN p_partkey % 7 = 6 THEN 'building' ELSE 'none' END AS layer FROM part""",
)
def element_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer of each element; a lift is nothing else, an unlisted highway is nothing."""
    return _ways(spark, sf_dir).select("id", F.coalesce(elements.layer(), F.lit("none")).alias("layer"))


@query(
    "road_columns",
    """SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'primary' ELSE 'path' END AS cls, p_partkey % 5 = 0 AS one_way, CASE WHEN p_partkey % 9 = 0 THEN 4 ELSE 0 END AS sac,
  CASE WHEN p_partkey % 6 = 1 THEN 2 ELSE -1 END AS mtb, CASE p_partkey % 4 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS bike_access, p_partkey % 7 = 5 AS steps FROM part WHERE p_partkey % 7 IN (0, 1, 5) AND p_partkey % 31 <> 0""",
)
def road_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads = elements.road_columns(_ways(spark, sf_dir).filter(elements.layer() == "road"))
    return roads.select("id", "cls", "one_way", "sac", "mtb", "bike_access", "steps")


@query(
    "junction_splits",
    """WITH u AS (SELECT l_orderkey AS way, l_partkey % 5000 AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
c AS (SELECT *, i > 0 AND i < n - 1 AND count(*) OVER (PARTITION BY node) > 1 AS cut FROM u)
SELECT way, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) + 1 AS BIGINT) AS parts FROM c GROUP BY way HAVING max(n) > 1""",
)
def junction_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ways over parts as nodes: how many parts each falls into."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice"))), lambda x: x["l_partkey"] % 5000)
    ways = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("way")).agg(line.alias("nodes"))
    return elements.split_at_junctions(ways).groupBy("way").agg(F.count("*").alias("parts"))


@query(
    "tile_lookup",
    """WITH e AS (SELECT p_partkey * 5 AS tile_id, p_partkey % 4 AS run, p_size AS length FROM part), t AS (SELECT o_orderkey AS tile FROM orders)
SELECT tile, coalesce(tile_id, -1) AS tile_id FROM t LEFT JOIN e ON tile >= tile_id AND tile < tile_id + run""",
)
def tile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory entry whose run holds each tile."""
    entries = _t(spark, sf_dir, "part").select((F.col("p_partkey") * 5).alias("tile_id"), (F.col("p_partkey") % 4).alias("run"))
    found = archive.lookup(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tile")), entries, 64)
    return found.select("tile", F.coalesce("tile_id", F.lit(-1)).alias("tile_id"))


@query(
    "raster_heights",
    """WITH c AS (SELECT c_custkey // 40 AS row, c_custkey % 40 AS col, CASE WHEN c_custkey % 17 = 0 THEN -9999 ELSE c_acctbal END AS h FROM customer),
p AS (SELECT s_suppkey AS pid, (s_suppkey * 337 % 3900) / 100e0 - 0.5e0 AS gx, (s_suppkey * 911 % 3600) / 100e0 - 0.5e0 AS gy FROM supplier),
a AS (SELECT pid, floor(gy) + dr AS row, floor(gx) + dc AS col, (CASE dr WHEN 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) * (CASE dc WHEN 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) AS w FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dr, dc))
SELECT p.pid, coalesce(round(sum(w * h) FILTER (h >= -1000) / nullif(sum(w) FILTER (h >= -1000), 0), 4), -9999) AS z FROM p LEFT JOIN a ON a.pid = p.pid LEFT JOIN c ON c.row = a.row AND c.col = a.col GROUP BY p.pid""",
)
def raster_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilinear heights at suppliers' places on a raster of customers' balances."""
    k = F.col("c_custkey")
    cells = _t(spark, sf_dir, "customer").select(F.expr("c_custkey div 40").alias("row"), (k % 40).alias("col"), F.when(k % 17 == 0, F.lit(-9999.0)).otherwise(F.col("c_acctbal")).alias("h"))
    s = F.col("s_suppkey")
    points = _t(spark, sf_dir, "supplier").select(s.alias("pid"), (s * 337 % 3900).cast("double").alias("px"), (s * 911 % 3600).cast("double").alias("py"))
    return rasters.sample(points, cells, 100.0).select("pid", F.coalesce(F.round("z", 4), F.lit(-9999.0)).alias("z"))


@query(
    "mask_cells",
    """WITH c AS (SELECT s_suppkey * 7 % 200 AS r, s_suppkey * 13 % 200 AS c FROM supplier), d AS (SELECT a.i AS dr, b.i AS dc FROM range(-3, 4) a(i), range(-3, 4) b(i) WHERE a.i * a.i + b.i * b.i <= 9)
SELECT DISTINCT r + dr AS row, c + dc AS col FROM c, d""",
)
def mask_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells within three of any supplier's."""
    s = F.col("s_suppkey")
    return rasters.dilate(_t(spark, sf_dir, "supplier").select((s * 7 % 200).alias("row"), (s * 13 % 200).alias("col")), 3)


@query(
    "region_summary",
    LATTICE
    + """SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM st) AS stretches, CAST((SELECT sum(len) FROM st) AS DOUBLE) AS meters,
  (SELECT count(*) FROM st WHERE grid_cls = 'primary') AS car_stretches, (SELECT count(*) FROM st WHERE st % 2 = 0) AS marked""",
)
def region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a build of the region holds."""
    r = region.load(spark, sf_dir)
    st = catalogue.join_statistics(r.stretches.withColumn("car", access.usable("car")).withColumn("marked", F.col("hike_ref") != ""), ["car", "marked"])
    total = r.stretches.agg(F.sum("len").alias("meters"))
    return r.nodes.agg(F.count("*").alias("nodes")).crossJoin(st).crossJoin(total).select("nodes", F.col("rows").alias("stretches"), "meters", F.col("car").alias("car_stretches"), "marked")
