"""Rings of areas: sizes, holes, and areas too small to draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .tables import written

#: Fixed value: buildings below this are not worth a polygon.
BUILDING_M2 = 60.0
#: Rings whose edges may come near a cell before it is cut in four, and how often that is done at most.
CROWD, CUTS = 64, 7


def worth_drawing(layer: Column, ring: str) -> Column:
    """False for small buildings."""
    return (layer != "buildings") | (F.abs(geo.ring_area(ring)) >= BUILDING_M2)


_KEY = ["l", "cx", "cy"]


def _sided(cells: DataFrame) -> DataFrame:
    """Cells of rings: `touched` where an edge comes near; of the others, which are on one side of the ring, those inside."""
    # The margin is beyond what the inside test can lose by rounding.
    margin = "(w * 1e-6D + 1e-12D * (abs(cx * w) + abs(cy * w)))"
    near = " and ".join(f"least(ring[i].{c}, ring[i+1].{c}) <= (c{c} + 1) * w + {margin} and greatest(ring[i].{c}, ring[i+1].{c}) >= c{c} * w - {margin}" for c in "xy")
    # Of a slanting edge, whose box is large, the line must come near too.
    near += f" and abs((ring[i+1].x - ring[i].x) * (my - ring[i].y) - (ring[i+1].y - ring[i].y) * (mx - ring[i].x)) <= (abs(ring[i+1].x - ring[i].x) + abs(ring[i+1].y - ring[i].y)) * (w / 2 + {margin})"
    at = cells.withColumn("w", F.expr("pow(2D, l)")).withColumn("mx", F.expr("(cx + 0.5D) * w")).withColumn("my", F.expr("(cy + 0.5D) * w"))
    at = at.withColumn("touched", F.expr(f"exists(sequence(0, size(ring) - 2), i -> {near})"))
    return at.filter(F.col("touched") | geo.inside("mx", "my", "ring")).select(*_KEY, "less", "outer", "ring", "first", "touched")


def _cells(outer: DataFrame) -> DataFrame:
    """The cells that a ring's box touches: 2**l wide, a quarter to half of the box, so no ring has more than 25."""
    side = lambda c, f: F.expr(f"{f}(transform(ring, p -> p.{c}))")
    box = outer.groupBy("ring").agg(F.min("id").alias("outer")).select("outer", (-F.abs(geo.ring_area("ring"))).alias("less"), "ring", *[side(c, f"array_{f}").alias(f"{f}_{c}") for c in "xy" for f in ("min", "max")])
    box = box.filter("max_x > min_x and max_y > min_y").withColumn("l", F.expr("cast(ceil(log2(greatest(max_x - min_x, max_y - min_y))) as int) - 2"))
    for c in "xy":
        box = box.withColumn(f"c{c}", F.explode(F.expr(f"sequence(cast(floor(min_{c} / pow(2D, l)) as long), cast(floor(max_{c} / pow(2D, l)) as long))")))
    return box.withColumn("first", F.lit(None).cast("struct<less:double,outer:long>"))


def assign_holes(rings: DataFrame) -> DataFrame:
    """hole, outer: each hole's first outer ring, largest area first, that holds its first corner; null without one.

    rings: id long, ring (closed array of structs x, y), inner.  Of the rings
    that hold all of a cell only the first counts there, and of those whose
    edges come near it only such as come before that one.  Cells that are
    still crowded are cut in four; what is crowded after the last cut is
    tested in full.
    """
    candidates = None
    cells = _sided(_cells(written(rings.filter("not inner").select("id", "ring"))))
    for cut in range(CUTS + 1):
        cells = written(cells)
        whole = cells.filter("not touched").groupBy(*_KEY).agg(F.min(F.struct("less", "outer")).alias("own"))
        part = cells.filter("touched").join(whole, _KEY, "left").withColumn("first", F.least("first", "own")).filter("first is null or struct(less, outer) < first")
        part = written(part.select(*_KEY, "less", "outer", "ring", "first"))
        crowded = part.groupBy(*_KEY).agg(F.count("*").alias("n")).filter(f"n > {CROWD}").select(*_KEY)
        last = cut == CUTS or crowded.isEmpty()
        found = (part if last else part.join(crowded, _KEY, "left_anti")).select(*_KEY, "less", "outer", "ring").unionByName(whole.select(*_KEY, "own.*"), allowMissingColumns=True)
        candidates = found if candidates is None else candidates.unionByName(found)
        if last:
            break
        four = part.join(crowded, _KEY, "left_semi").withColumn("q", F.explode(F.expr("sequence(0, 3)")))
        cells = _sided(four.withColumns({"l": F.expr("l - 1"), "cx": F.expr("2 * cx + q % 2"), "cy": F.expr("2 * cy + q div 2")}))
    candidates = written(candidates)
    corners = rings.filter("inner").select(F.col("id").alias("hole"), F.expr("ring[0].x").alias("hx"), F.expr("ring[0].y").alias("hy"))
    at = corners.crossJoin(F.broadcast(candidates.select("l").distinct()))
    at = at.select("hole", "hx", "hy", "l", *[F.expr(f"cast(floor(h{c} / pow(2D, l)) as long)").alias(f"c{c}") for c in "xy"])
    held = at.join(candidates, _KEY).filter(F.col("ring").isNull() | geo.inside("hx", "hy", "ring"))
    first = held.groupBy("hole").agg(F.min(F.struct("less", "outer")).alias("b")).select("hole", "b.outer")
    return corners.select("hole").join(first, "hole", "left")
