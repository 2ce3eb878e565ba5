"""Order-dependent operators on lines and steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a step must be to stand alone.
MIN_STEP_M, MAX_STEPS = 150.0, 40


def running(value: Column, by: list[str], order: list[str]) -> Column:
    """Cumulative sum along an order."""
    return F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def islands(df: DataFrame, by: list[str], order: list[str], same: list[str]) -> DataFrame:
    """df with `island`: numbers runs of rows that agree in the columns of `same`."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn("_new", (first | changed).cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def fold_steps(steps: list[dict], least: float = MIN_STEP_M, most: int = MAX_STEPS) -> list[dict]:
    """Folds the shortest step into its longer neighbour of the same mode, while it is short or there are too many.

    Lifts are never folded; of equally short steps the first goes, of equally
    long neighbours the left takes it.
    """
    out = [dict(s) for s in steps]
    while True:
        best = -1
        for i, s in enumerate(out):
            if s["mode"] == "lift" or (s["meters"] >= least and len(out) <= most):
                continue
            beside = [j for j in (i - 1, i + 1) if 0 <= j < len(out) and out[j]["mode"] == s["mode"]]
            if beside and (best < 0 or s["meters"] < out[best]["meters"]):
                best = i
        if best < 0:
            return out
        beside = [j for j in (best - 1, best + 1) if 0 <= j < len(out) and out[j]["mode"] == out[best]["mode"]]
        into = max(beside, key=lambda j: (out[j]["meters"], -j))
        out[into]["name"] = out[into]["name"] if out[into]["meters"] >= out[best]["meters"] else out[best]["name"]
        for c in ("meters", "seconds"):
            out[into][c] += out[best][c]
        del out[best]


def folded(df: DataFrame) -> DataFrame:
    """id, steps (array of structs name, mode, meters, seconds): the steps folded."""
    kind = df.schema["steps"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps = [fold_steps(s or []) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(steps, b.schema.field(1).type)], names=["id", "steps"])

    return df.select("id", "steps").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, steps {kind}")


def simplify(points: list[tuple[float, float]], eps: float) -> list[tuple[float, float]]:
    """Douglas-Peucker; a closed ring is split at the point farthest from its start."""

    def keep(lo: int, hi: int, kept: set[int]) -> None:
        stack = [(lo, hi)]
        while stack:
            a, b = stack.pop()
            (ax, ay), (bx, by) = points[a], points[b]
            dx, dy = bx - ax, by - ay
            n2 = dx * dx + dy * dy
            far, at = eps, -1
            for i in range(a + 1, b):
                px, py = points[i]
                t = 0.0 if n2 == 0 else max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / n2))
                d = ((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2) ** 0.5
                if d > far:
                    far, at = d, i
            if at >= 0:
                kept.add(at)
                stack += [(a, at), (at, b)]

    n = len(points)
    if n < 3:
        return list(points)
    kept = {0, n - 1}
    if points[0] == points[-1]:
        x0, y0 = points[0]
        far = max(range(n), key=lambda i: ((points[i][0] - x0) ** 2 + (points[i][1] - y0) ** 2, -i))
        kept.add(far)
        keep(0, far, kept)
        keep(far, n - 1, kept)
    else:
        keep(0, n - 1, kept)
    return [points[i] for i in sorted(kept)]


def profile(cum: str, z: str, step: float) -> Column:
    """Heights every `step` metres along a line (arrays of distances and heights), the end too if over a metre beyond.

    null where a height is missing.  Arrays of equal length, distances ascending.
    """
    total = f"element_at({cum}, -1)"
    at = f"transform(sequence(0, cast(floor({total} / {step}) as int)), k -> k * {step})"
    at = f"if({total} - element_at({at}, -1) > 1, concat({at}, array({total})), {at})"
    # The segment of d is the first whose end reaches it.
    seg = f"greatest(1, size(filter({cum}, c -> c < d)))"
    height = f"""transform(array({seg}), i -> if(i >= size({cum}), element_at({z}, -1), if({cum}[i] - {cum}[i-1] = 0, {z}[i],
        {z}[i-1] + ({z}[i] - {z}[i-1]) * (d - {cum}[i-1]) / ({cum}[i] - {cum}[i-1]))))[0]"""
    return F.expr(f"if(size({z}) = 0 or exists({z}, v -> v is null), null, transform({at}, d -> named_struct('d', d, 'z', {height})))")
