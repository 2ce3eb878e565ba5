"""Nearest-neighbour joins on a plane: cells and an equi-join, then the exact distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest(points: DataFrame, targets: DataFrame, radius: float, prefer: Column | None = None, prefer_within: float = 0.0) -> DataFrame:
    """For each point (pid, px, py) its nearest target (tid, tx, ty) within a radius.

    prefer: a condition on target columns; the nearest such target within
    `prefer_within` wins over a nearer one.  Ties go to the least tid.  Returns
    pid, tid, dist; points without a target have nulls.  Each point looks into
    the nine cells around it, cells being as wide as the radius, so no pair
    that is farther than that is ever made but for the corners.
    """
    wanted = F.lit(False) if prefer is None else prefer
    t = targets.withColumn("wanted", wanted).select("tid", "tx", "ty", "wanted", F.floor(F.col("tx") / radius).alias("cx"), F.floor(F.col("ty") / radius).alias("cy"))
    p = points.select("pid", "px", "py", F.explode(F.expr(f"transform(sequence(0, 8), i -> struct(floor(px / {radius}) + i % 3 - 1 as cx, floor(py / {radius}) + i div 3 - 1 as cy))")).alias("c"))
    pairs = p.select("pid", "px", "py", "c.cx", "c.cy").join(t, ["cx", "cy"])
    d = F.sqrt(F.pow(F.col("px") - F.col("tx"), 2) + F.pow(F.col("py") - F.col("ty"), 2))
    near = pairs.withColumn("dist", d).filter(F.col("dist") <= radius)
    rank = F.struct((~(F.col("wanted") & (F.col("dist") <= prefer_within))).alias("other"), "dist", "tid")
    best = near.groupBy("pid").agg(F.min(rank).alias("best"))
    return points.select("pid").join(best, "pid", "left").select("pid", F.col("best.tid").alias("tid"), F.col("best.dist").alias("dist"))
