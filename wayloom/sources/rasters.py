"""Elevation rasters and cell masks as tables: tiles are keyed, samples are joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = -1000.0


def sample(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """pid, z: bilinear heights at points (pid, px, py) from cells (row, col, h) whose centres are half a cell in.

    Void cells (null or below -1000) drop out and the rest are weighted anew;
    null without any.
    """
    gx, gy = F.col("px") / size - 0.5, F.col("py") / size - 0.5
    p = points.withColumn("c0", F.floor(gx)).withColumn("r0", F.floor(gy)).withColumn("fx", gx - F.floor(gx)).withColumn("fy", gy - F.floor(gy))
    corner = lambda dr, dc: F.struct((F.col("r0") + dr).alias("row"), (F.col("c0") + dc).alias("col"), ((F.col("fy") if dr else 1 - F.col("fy")) * (F.col("fx") if dc else 1 - F.col("fx"))).alias("w"))
    around = p.select("pid", F.inline(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))))
    heights = around.join(cells.filter(F.col("h") >= VOID), ["row", "col"]).groupBy("pid").agg((F.sum(F.col("w") * F.col("h")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("z"))
    return points.select("pid").join(heights, "pid", "left")


def dilate(cells: DataFrame, radius: int) -> DataFrame:
    """row, col within a disk of any cell."""
    disk = [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]
    offsets = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in disk])
    return cells.select("row", "col", F.explode(offsets).alias("o")).select((F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col")).distinct()


def within(lines: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """Lines (id, points of structs x, y) with a point in any cell: a semi-join."""
    at = lines.select("id", F.explode("points").alias("p")).select("id", F.floor(F.col("p.y") / size).alias("row"), F.floor(F.col("p.x") / size).alias("col"))
    return lines.join(at.join(cells, ["row", "col"], "left_semi").select("id").distinct(), "id", "left_semi")
