"""Lifts: rides, links to the paths around their stations, and chains of sections.

Lifts are few beside stretches, but nothing here counts on it: all joins are
equi-joins on cells, and chains are followed by a few rounds of joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import access, geo
from .snap import nearest
from .tables import written

# How far a station's path may be, how far apart two sections may end, and how many sections a chain has.
LINK_M, CHAIN_GAP_M, CHAIN_HOPS = 100.0, 250.0, 8


def _rising(lifts: DataFrame, nodes: DataFrame) -> DataFrame:
    """lifts with the heights of their ends, and whether a -> b is the way up (it is where heights are not known)."""
    end = lambda c: nodes.select(F.col("node").alias(c), F.col("z").alias(f"z_{c}"))
    both = lifts.filter("len > 0").join(end("a"), "a").join(end("b"), "b")
    return both.withColumn("rises", F.coalesce(F.col("z_b") >= F.col("z_a"), F.lit(True)))


def rides(lifts: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, st, w, rev: lifts (st, a, b, kind, len, published, uphill) as directed edges; lifts that only go uphill have one."""
    up = _rising(lifts, nodes).withColumn("w", access.lift_seconds(F.col("kind"), F.col("len"), F.col("published")).cast("float"))
    forth = up.filter("not uphill or rises").select(F.col("a").alias("src"), F.col("b").alias("dst"), "st", "w", F.lit(False).alias("rev"))
    back = up.filter("not uphill or not rises").select(F.col("b").alias("src"), F.col("a").alias("dst"), "st", "w", F.lit(True).alias("rev"))
    return forth.union(back)


def links(lifts: DataFrame, nodes: DataFrame, walkable: DataFrame) -> DataFrame:
    """station, node, len, w: for each end of a lift the nearest other walking junction within LINK_M, and the walk there.

    walkable: node, x, y, z.  The walk is an unmarked path's, and costs the same both ways.
    """
    stations = lifts.filter("len > 0").select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
    points = stations.select(F.col("node").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"))
    targets = walkable.select(F.col("node").alias("tid"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    found = nearest(points, targets, LINK_M).filter("tid is not null and tid <> pid")
    rise = found.join(stations.select(F.col("node").alias("pid"), F.col("z").alias("from_z")), "pid").join(walkable.select(F.col("node").alias("tid"), F.col("z").alias("to_z")), "tid")
    path = rise.select(
        F.col("pid").alias("station"), F.col("tid").alias("node"), F.col("dist").alias("len"), F.lit("path").alias("cls"), F.lit("").alias("hike_ref"), F.lit("").alias("sat_no"), F.lit(0).alias("sac"),
        F.coalesce(F.greatest(F.col("to_z") - F.col("from_z"), F.lit(0.0)), F.lit(0.0)).alias("up"), F.coalesce(F.greatest(F.col("from_z") - F.col("to_z"), F.lit(0.0)), F.lit(0.0)).alias("down"),
    )
    return path.select("station", "node", "len", access.weight("hike").cast("float").alias("w"))


def chain_bottoms(lifts: DataFrame, nodes: DataFrame) -> DataFrame:
    """station, bottom: the lowest station that sections lead down to; null where a station is the lowest itself.

    From a station the section whose upper end is near it and whose lower end
    is lowest is followed, as often as that leads further down.
    """
    sections = _rising(lifts, nodes).filter("z_a is not null and z_b is not null")
    sections = sections.select(F.when(F.col("rises"), F.col("a")).otherwise(F.col("b")).alias("low"), F.when(F.col("rises"), F.col("b")).otherwise(F.col("a")).alias("high"), F.least("z_a", "z_b").alias("low_z"), "st")
    place = nodes.select("node", "x", "y", "z")
    tops = sections.join(place.select(F.col("node").alias("high"), F.col("x").alias("hx"), F.col("y").alias("hy")), "high")
    near = [F.struct((F.floor(F.col("hx") / CHAIN_GAP_M) + i).alias("cx"), (F.floor(F.col("hy") / CHAIN_GAP_M) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    tops = written(tops.select("low", "low_z", "st", "hx", "hy", F.explode(F.array(*near)).alias("c")).select("low", "low_z", "st", "hx", "hy", "c.cx", "c.cy"))
    stations = lifts.filter("len > 0").select(F.explode(F.array("a", "b")).alias("station")).distinct()
    held = written(stations.join(place, F.col("station") == F.col("node")).select("station", F.col("node").alias("bottom"), "x", "y", "z", F.lit(True).alias("moved")))
    for _ in range(CHAIN_HOPS):
        # Cells are as wide as the gap, so near ends are in neighbouring ones.
        at = held.filter("moved and z is not null").withColumn("cx", F.floor(F.col("x") / CHAIN_GAP_M)).withColumn("cy", F.floor(F.col("y") / CHAIN_GAP_M))
        lower = at.join(tops, ["cx", "cy"]).filter(f"low_z < z and sqrt(pow(hx - x, 2) + pow(hy - y, 2)) <= {CHAIN_GAP_M}")
        step = lower.groupBy("station").agg(F.min(F.struct("low_z", "st", "low")).alias("s")).select("station", F.col("s.low").alias("next"))
        step = step.join(place.select(F.col("node").alias("next"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz")), "next")
        merged = held.join(step, "station", "left")
        moved = F.col("next").isNotNull()
        held = written(merged.select("station", *[F.when(moved, F.col(n)).otherwise(F.col(o)).alias(o) for o, n in (("bottom", "next"), ("x", "nx"), ("y", "ny"), ("z", "nz"))], moved.alias("moved")))
        if held.filter("moved").isEmpty():
            break
    return held.select("station", F.when(F.col("bottom") != F.col("station"), F.col("bottom")).alias("bottom"))


def lift_near(points: DataFrame, lines: DataFrame, radius: float = 30.0, cell: float = 500.0) -> DataFrame:
    """pid, st, dist: the nearest lift line within a radius of each point (pid, px, py); points without one are left out.

    lines: st, line array of structs x, y.  A line is found by the cells that its segments' boxes touch.
    """
    pieces = lines.select("st", "line", F.explode(F.expr("transform(sequence(0, size(line) - 2), i -> struct(line[i] as a, line[i + 1] as b))")).alias("s"))
    low = lambda c: F.floor((F.least(F.col(f"s.a.{c}"), F.col(f"s.b.{c}")) - radius) / cell)
    high = lambda c: F.floor((F.greatest(F.col(f"s.a.{c}"), F.col(f"s.b.{c}")) + radius) / cell)
    cells = pieces.withColumn("cx", F.explode(F.sequence(low("x"), high("x")))).withColumn("cy", F.explode(F.sequence(low("y"), high("y"))))
    at = points.withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))
    d = F.expr(geo.to_segment_sql("px", "py", "s.a.x", "s.a.y", "s.b.x", "s.b.y"))
    near = at.join(cells, ["cx", "cy"]).withColumn("dist", d).filter(F.col("dist") <= radius)
    return near.groupBy("pid").agg(F.min(F.struct("dist", "st")).alias("best")).select("pid", "best.st", "best.dist")
