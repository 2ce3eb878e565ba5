"""Joins of stretches with registers of trails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text

# How near a stretch's points must be to a trail's line, and what part of them; what a trail's end is.
NEAR_M, NEAR_PART, TRAIL_END_M, MIN_TRAIL_M = 60.0, 0.8, 100.0, 500.0


def match_by_number(stretches: DataFrame, trails: DataFrame, radius: float) -> DataFrame:
    """st, trail: for each stretch (st, number, x, y) the nearest trail (trail, number, x, y) that shares a form of its number.

    Numbers are joined on their normal forms, so `E05` meets `5`; the distance
    test follows, and the best of each stretch is a partial aggregation.
    """
    s = stretches.select("st", "x", "y", F.explode(text.trail_keys(F.col("number"))).alias("key"))
    t = trails.select("trail", F.col("x").alias("tx"), F.col("y").alias("ty"), F.explode(text.trail_keys(F.col("number"))).alias("key"))
    pairs = s.join(t, "key").withColumn("d", F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2))).filter(F.col("d") <= radius)
    return pairs.groupBy("st").agg(F.min(F.struct("d", "trail")).alias("best")).select("st", "best.trail")


def match_by_line(stretches: DataFrame, trails: DataFrame, radius: float = NEAR_M, part: float = NEAR_PART) -> DataFrame:
    """st, trail, part, median: for each stretch the trail of its number that most of its points lie on.

    stretches: st, number, points (array of structs x, y); trails: trail,
    number, line (likewise).  Of trails that share a form of the number and
    whose box comes within the radius, the one with the greatest part of
    points within the radius is taken, of equal ones that of the least median
    distance, then the least; below `part` it is none.
    """
    box = lambda a: [F.array_min(F.transform(a, lambda p: p["x"])), F.array_max(F.transform(a, lambda p: p["x"])), F.array_min(F.transform(a, lambda p: p["y"])), F.array_max(F.transform(a, lambda p: p["y"]))]
    s = stretches.select("st", "points", *[c.alias(f"s{i}") for i, c in enumerate(box(F.col("points")))], F.explode(text.trail_keys(F.col("number"))).alias("key"))
    t = trails.select("trail", "line", *[c.alias(f"t{i}") for i, c in enumerate(box(F.col("line")))], F.explode(text.trail_keys(F.col("number"))).alias("key"))
    near = f"t1 >= s0 - {radius} and t0 <= s1 + {radius} and t3 >= s2 - {radius} and t2 <= s3 + {radius}"
    # A pair that shares several forms is measured once.
    pairs = s.join(t, "key").filter(near).dropDuplicates(["st", "trail"]).select("st", "trail", "line", F.explode("points").alias("p"))
    d = pairs.withColumn("d", geo.to_line("p.x", "p.y", "line"))
    fit = d.groupBy("st", "trail").agg(F.avg((F.col("d") <= radius).cast("int")).alias("part"), F.median("d").alias("median"))
    best = fit.groupBy("st").agg(F.min(F.struct((-F.col("part")).alias("less"), "median", "trail")).alias("b"))
    return best.filter(f"-b.less >= {part}").select("st", "b.trail", (-F.col("b.less")).alias("part"), "b.median")


def at_trail_end(points: str, ends: str, sac: Column, grade: Column, ferrata: Column, line_m: Column) -> Column:
    """Whether a stretch keeps its own lower grade: all of it is near one end of a trail that is long enough."""
    near = F.expr(f"exists({ends}, e -> forall({points}, p -> sqrt(pow(p.x - e.x, 2) + pow(p.y - e.y, 2)) <= {TRAIL_END_M}))")
    return ~ferrata & (sac >= 1) & (sac < grade) & (line_m >= MIN_TRAIL_M) & near


def join_statistics(joined: DataFrame, flags: list[str]) -> DataFrame:
    """One row of counts: all rows, and those with each flag."""
    return joined.agg(F.count("*").alias("rows"), *[F.count(F.when(F.col(f), 1)).alias(f) for f in flags])
