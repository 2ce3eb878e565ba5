"""Keys, formatted values and small codecs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of accuracy in per cent.
PASS, CHECK = 15, 30
EARTH_M = 6371008.8
THIN = "\u2009"


def refusal_key(mode: Column, grade: Column, lifts: Column, points: Column, avoid: Column) -> Column:
    """Key of a refused request: points are structs lat, lon, via; ways to avoid structs lat, lon; six decimals."""
    place = lambda p, mark: F.format_string(f"|{mark}%.6f,%.6f", p["lat"], p["lon"])
    stops = F.array_join(F.transform(points, lambda p: F.concat(place(p, ""), F.when(F.coalesce(p["via"], F.lit(False)), "v").otherwise(""))), "")
    barred = F.array_join(F.transform(avoid, lambda p: place(p, "x")), "")
    return F.concat(mode, F.lit("|"), grade, F.when(lifts, "|lifts").otherwise(""), stops, barred)


def far_coordinate(reason: Column) -> Column:
    """Struct lat, lon of the point that a reason names: after `of`, or else at its end; null without one."""
    first, last = r"\bof\s+(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)", r"(-?\d+\.\d+)\s*,\s*(-?\d+\.\d+)\s*$"
    at = lambda p: F.struct(F.regexp_extract(reason, p, 1).cast("double").alias("lat"), F.regexp_extract(reason, p, 2).cast("double").alias("lon"))
    return F.when(reason.rlike(first), at(first)).when(reason.rlike(last), at(last))


def host_only(host: Column) -> Column:
    """A host without its port; the brackets of an address stay."""
    return F.when(host.rlike(r"^.+:[^:\]]*$"), F.regexp_extract(host, r"^(.+):[^:]*$", 1)).otherwise(host)


def clamped(limit: Column, most: int, default: int) -> Column:
    """A limit from 1 to `most`, or else the default."""
    return F.when(limit.between(1, most), limit).otherwise(default)


def per_cent(ours: Column, theirs: Column) -> Column:
    return F.when(theirs != 0, (ours - theirs) / theirs * 100.0)


def verdict(deltas: Column) -> Column:
    """`pass`, `check` or `fail` by the largest deviation in per cent; `n/a` without any."""
    worst = F.array_max(F.transform(F.filter(deltas, lambda d: d.isNotNull()), F.abs))
    return F.when(worst.isNull(), "n/a").when(worst <= PASS, "pass").when(worst <= CHECK, "check").otherwise("fail")


def grouped(n: Column) -> Column:
    """A whole number with a thin space between its groups of three digits."""
    return F.regexp_replace(F.format_number(F.floor(n + 0.5), 0), ",", THIN)


def duration(seconds: Column) -> Column:
    """`2 h 35 min`, `48 min`, `< 1 min`; a dash for what is no duration."""
    total = F.floor(seconds / 60 + 0.5).cast("long")
    h, m = F.expr("bigint(0)") + F.floor(total / 60), total % 60
    text = lambda c: c.cast("string")
    return (
        F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), "—").when(total < 1, "< 1 min").when(h == 0, F.concat(text(m), F.lit(" min")))
        .when(m == 0, F.concat(text(h), F.lit(" h"))).otherwise(F.concat(text(h), F.lit(" h "), text(m), F.lit(" min")))
    )


def distance(metres: Column) -> Column:
    """`850 m` in tens, `9.3 km`, `12 km`; a dash for what is no distance."""
    tens = F.concat((F.floor(metres / 10 + 0.5) * 10).cast("string"), F.lit(" m"))
    return F.when(metres.isNull() | F.isnan(metres) | (metres < 0), "—").when(metres < 1000, tens).when(metres < 10000, F.format_string("%.1f km", metres / 1000)).otherwise(F.concat(grouped(metres / 1000), F.lit(" km")))


def offset(metres: Column) -> Column:
    """How far a point had to move: `120 m`, `1.4 km`."""
    return F.when(metres >= 1000, F.format_string("%.1f km", metres / 1000)).otherwise(F.concat(F.floor(metres + 0.5).cast("string"), F.lit(" m")))


def height(metres: Column, sign: str = "") -> Column:
    """A height, ungrouped up to four digits, after `+` for an ascent or a minus sign for a descent."""
    n = F.floor(F.abs(metres) + 0.5)
    return F.concat(F.lit(sign), F.when(n >= 10000, grouped(n)).otherwise(n.cast("string")), F.lit(" m"))


def merged_classes(a: Column, b: Column) -> Column:
    """Two maps from class to metres, added."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def disc(lat: Column, lon: Column, metres: Column, corners: int = 48) -> Column:
    """A closed ring of structs lon, lat around a place."""
    dlat = F.degrees(metres / EARTH_M)
    dlon = dlat / F.greatest(F.cos(F.radians(lat)), F.lit(0.01))
    turn = lambda i: i * (2 * 3.141592653589793 / corners)
    return F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda i: F.struct((lon + dlon * F.cos(turn(i % corners))).alias("lon"), (lat + dlat * F.sin(turn(i % corners))).alias("lat")))


def join_lines(lines: Column) -> Column:
    """Lines one after the other; a line that begins where the one before ended does not repeat that place."""
    kept = F.transform(lines, lambda line, i: F.when((i > 0) & (F.size(line) > 0) & (F.element_at(F.get(lines, i - 1), -1) == line[0]), F.slice(line, 2, F.size(line))).otherwise(line))
    return F.flatten(kept)
