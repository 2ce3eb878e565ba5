"""Who may use a stretch, and what it costs: column expressions over stretch columns.

Stretch columns: cls, len, up, down, mtb (-1 untagged), bike_access and
foot_access (-1, 0, 1), steps, ferrata (boolean), hike_ref, bike_ref (empty if
none), sac (0 if none), sat_grade, sat_no.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("car", "bike", "hike")
PLANS = ("car", "bike", "hike", "car+hike", "bike+hike")
GRADES = ("", "T", "E", "EE", "EEA", "A")
# Classes a mode may use, speeds in m/s and km/h, and seconds of fixed charges.
CAR_CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service")
BIKE_CLASSES = ("primary", "secondary", "tertiary", "residential", "service", "cycleway", "pedestrian")
HIKE_CLASSES = ("path", "track", "pedestrian", "cycleway", "residential", "service", "tertiary", "secondary", "primary")
CAR_SPEED = {"motorway": 27.7, "trunk": 27.7, "primary": 16.6, "secondary": 16.6, "service": 8.3}
CAR_SPEED_ELSE = 13.9
BIKE_SPEED = {"cycleway": 16.0, "track": 12.0, "path": 8.0, "pedestrian": 8.0}
BIKE_SPEED_ELSE, BIKE_TOP = 15.0, 40.0
BIKE_FACTOR = {"primary": 1.6, "secondary": 1.25}
BIKE_UNMARKED = 1.05
WALK_FLAT, WALK_UP, WALK_DOWN = 4000 / 3600, 400 / 3600, 800 / 3600
RAMP_S, SWITCH_S, BOARD_S = 20.0, 120.0, 300.0
LIFT_SPEED = {"cable_car": 10.0, "gondola": 5.0, "chair_lift": 2.5}
LIFT_SPEED_ELSE = 4.0


def by_class(values: dict[str, float], other: float, c: Column | None = None) -> Column:
    c = F.col("cls") if c is None else c
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def usable(mode: str) -> Column:
    """Whether the mode may travel a stretch at all; grades are judged per request."""
    cls = F.col("cls")
    if mode == "car":
        return cls.isin(*CAR_CLASSES)
    if mode == "bike":
        allowed = (F.col("bike_access") >= 0) & ~F.col("steps") & ~F.col("ferrata") & (cls != "lift")
        track = (cls == "track") & (F.col("mtb") <= 2)
        path = (cls == "path") & ((F.col("bike_access") > 0) | F.col("mtb").between(0, 1))
        return allowed & (cls.isin(*BIKE_CLASSES) | track | path)
    return (F.col("foot_access") >= 0) & (cls != "lift") & (cls.isin(*HIKE_CLASSES) | F.col("ferrata") | F.col("steps"))


def effective_grade() -> Column:
    """The trail register's grade where it has one, else the map's scale."""
    return F.when(F.coalesce("sat_grade", F.lit(0)) > 0, F.col("sat_grade")).otherwise(F.coalesce("sac", F.lit(0)))


def grade_ordinal(name: Column) -> Column:
    """Ordinal of a grade's letters; what follows a hyphen does not count; 0 if unknown."""
    letters = F.upper(F.trim(F.split(name, "-")[0]))
    out = F.lit(0)
    for i, g in enumerate(GRADES[1:], 1):
        out = F.when(letters == g, i).otherwise(out)
    return out


def grade_ceiling(ordinal: Column) -> Column:
    return F.when(ordinal >= 5, 6).otherwise(ordinal)


def weight(mode: str, reverse: bool = False) -> Column:
    """Seconds to travel a stretch, forward or in reverse."""
    up, down = (F.col("down"), F.col("up")) if reverse else (F.col("up"), F.col("down"))
    length = F.col("len")
    if mode == "car":
        return length / by_class(CAR_SPEED, CAR_SPEED_ELSE)
    if mode == "bike":
        base = by_class(BIKE_SPEED, BIKE_SPEED_ELSE)
        factor = by_class(BIKE_FACTOR, 1.0) * F.when(F.col("bike_ref") == "", F.lit(BIKE_UNMARKED)).otherwise(F.lit(1.0))
        slope = F.when(length > 0, F.greatest(F.lit(-0.3), F.least(F.lit(0.3), (up - down) / length))).otherwise(F.lit(0.0))
        speed = F.when(slope > 0, base / (1 + 12 * slope)).when(slope < 0, F.least(base * (1 - 3 * slope), F.lit(BIKE_TOP))).otherwise(base)
        return factor * length / (speed / 3.6)
    flat, climb = length / WALK_FLAT, up / WALK_UP + down / WALK_DOWN
    marked = (F.col("hike_ref") != "") | (F.coalesce("sat_no", F.lit("")) != "")
    kind = F.when(marked, F.lit(0.9)).when(F.col("cls") == "primary", F.lit(1.5)).otherwise(F.lit(1.2))
    ground = F.when(F.col("sac") == 5, F.lit(1.6)).when(F.col("sac") == 6, F.lit(2.0)).otherwise(F.lit(1.0))
    return (F.greatest(flat, climb) + F.least(flat, climb) / 2) * kind * ground


def lift_seconds(kind: Column, length: Column, published: Column) -> Column:
    """A ride: the published duration or length at the kind's speed, and boarding."""
    return F.coalesce(F.nullif(published, F.lit(0.0)), length / by_class(LIFT_SPEED, LIFT_SPEED_ELSE, kind)) + BOARD_S
