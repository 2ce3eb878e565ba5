"""Regions as tables: nodes, stretches, and directed edges by mode.

A region is two DataFrames: nodes (node, x, y, z; metres, y grows south) and
stretches (st, a, b, one_way and the columns of `functions.access`).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import access


class Region(NamedTuple):
    nodes: DataFrame
    stretches: DataFrame


#: Columns a stretch may lack, and what they then are.
DEFAULTS = {
    "cls": "''", "one_way": "false", "up": "0D", "down": "0D", "mtb": "-1", "bike_access": "0", "foot_access": "0", "steps": "false", "ferrata": "false",
    "hike_ref": "''", "bike_ref": "''", "sac": "0", "sat_grade": "0", "sat_no": "''", "name": "''",
}


def complete(stretches: DataFrame) -> DataFrame:
    """Stretches with every column; what is absent or null takes its default."""
    have = set(stretches.columns)
    return stretches.withColumns({c: F.coalesce(F.col(c), F.expr(d)) if c in have else F.expr(d) for c, d in DEFAULTS.items()})


def lattice(customers: DataFrame, structural: bool = True) -> Region:
    """A grid region over customers: a node each, stretches to the right and lower neighbour.

    structural: rows and columns divisible by four are main roads, the rest
    tracks and paths; otherwise classes follow the market segment, which
    breaks the road network into many pieces.
    """
    size = F.broadcast(customers.agg(F.count("*").alias("n"), F.ceil(F.sqrt(F.count("*"))).cast("long").alias("w")))
    grid = customers.crossJoin(size).select(
        F.col("c_custkey").alias("node"), "n", "w", (F.col("c_custkey") % F.col("w")).alias("ix"), F.expr("c_custkey div w").alias("iy"), (F.col("c_acctbal") / 10).alias("z"), "c_mktsegment", "c_nationkey"
    )
    nodes = grid.select("node", (F.col("ix") * 1000.0).alias("x"), (F.col("iy") * 1000.0).alias("y"), "z")
    if structural:
        side = lambda i: F.when(F.col(i) % 4 == 0, "primary").when((F.col("ix") + F.col("iy")) % 3 == 0, "path").otherwise("track")
        right_cls, down_cls = side("iy"), side("ix")
        one_way = F.lit(False)
    else:
        cls = access.by_class({"AUTOMOBILE": "primary", "BUILDING": "residential", "FURNITURE": "service", "HOUSEHOLD": "path"}, "track", F.col("c_mktsegment"))
        right_cls = down_cls = cls
        one_way = F.col("c_nationkey") % 5 == 0
    ends = F.array(
        F.when((F.col("ix") + 1 < F.col("w")) & (F.col("node") + 1 < F.col("n")), F.struct((F.col("node") * 2).alias("st"), (F.col("node") + 1).alias("b"), right_cls.alias("cls"))),
        F.when(F.col("node") + F.col("w") < F.col("n"), F.struct((F.col("node") * 2 + 1).alias("st"), (F.col("node") + F.col("w")).alias("b"), down_cls.alias("cls"))),
    )
    stretches = (
        grid.select(F.col("node").alias("a"), F.col("z").alias("za"), one_way.alias("one_way"), F.explode(F.filter(ends, lambda e: e.isNotNull())).alias("e"))
        .select("e.st", "a", "e.b", "e.cls", "one_way", "za")
        .join(nodes.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")
        .select(
            "st", "a", "b", "cls", "one_way", F.lit(1000.0).alias("len"),
            F.greatest(F.col("zb") - F.col("za"), F.lit(0.0)).alias("up"), F.greatest(F.col("za") - F.col("zb"), F.lit(0.0)).alias("down"),
            (F.col("st") % 5 - 1).cast("int").alias("mtb"),
            F.when(F.col("cls") == "path", (F.col("st") % 6 + 1).cast("int")).otherwise(0).alias("sac"),
            F.when(F.col("st") % 2 == 0, F.lit("401")).otherwise("").alias("hike_ref"),
            F.when(F.col("st") % 3 == 0, F.lit("7")).otherwise("").alias("bike_ref"),
            F.concat(F.lit("Via "), F.expr("cast(st div 8 as string)")).alias("name"),
        )
    )
    return Region(nodes, complete(stretches))


def directed(stretches: DataFrame, mode: str) -> DataFrame:
    """src, dst, st, w (float seconds), rev: both ways unless one-way; on foot always both."""
    own = stretches.filter(access.usable(mode))
    forward = own.select(F.col("a").alias("src"), F.col("b").alias("dst"), "st", access.weight(mode).cast("float").alias("w"), F.lit(False).alias("rev"))
    back = own if mode == "hike" else own.filter(~F.col("one_way"))
    return forward.union(back.select(F.col("b").alias("src"), F.col("a").alias("dst"), "st", access.weight(mode, reverse=True).cast("float").alias("w"), F.lit(True).alias("rev")))


def edges(region: Region) -> DataFrame:
    """Directed edges of all modes, with the mode."""
    parts = [directed(region.stretches, m).withColumn("mode", F.lit(m)) for m in access.MODES]
    return parts[0].union(parts[1]).union(parts[2])


def dense_ids(stretches: DataFrame) -> DataFrame:
    """node, id: dense numbers in order of first appearance as a stretch's end.

    The order is global, so ids are counted within ranges of positions first
    and then shifted by the ranges before.
    """
    ends = stretches.select(F.explode(F.array(F.struct((F.col("st") * 2).alias("p"), F.col("a").alias("node")), F.struct((F.col("st") * 2 + 1).alias("p"), F.col("b").alias("node")))).alias("e"))
    first = ends.groupBy("e.node").agg(F.min("e.p").alias("p")).withColumn("block", F.expr("p div 4096"))
    from pyspark.sql import Window

    counts = first.groupBy("block").agg(F.count("*").alias("n"))
    before = counts.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("skip"))
    inside = F.row_number().over(Window.partitionBy("block").orderBy("p"))
    return first.join(before, "block").select("node", (F.col("skip") + inside - 1).alias("id"))


def load(spark: SparkSession, sf_dir: str, structural: bool = True) -> Region:
    return lattice(spark.read.parquet(f"{sf_dir}/customer.parquet"), structural)
