"""Requests and answers: validation, addresses, shares and display forms, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.access import GRADES, PLANS

# What a request may hold.
MAX_STOPS, MAX_POINTS, MAX_AVOID, ALTERNATIVES = 20, 40, 20, (1, 3)
SHARE, TOP = 0.03, 3


def _off_map(c: Column) -> Column:
    return F.exists(c, lambda p: p["lat"].isNull() | p["lon"].isNull() | ~p["lat"].between(-90, 90) | ~p["lon"].between(-180, 180) | ((p["lat"] == 0) & (p["lon"] == 0)))


def error() -> Column:
    """The first rule that a request (mode, grade, alternatives, points, avoid) breaks; null if none."""
    stops = F.size(F.filter("points", lambda p: ~F.coalesce(p["via"], F.lit(False))))
    return F.coalesce(
        F.when(~F.coalesce("mode", F.lit("car")).isin(*PLANS), "bad mode"),
        F.when(~F.coalesce("grade", F.lit("E")).isin(*GRADES), "bad grade"),
        F.when(~F.coalesce("alternatives", F.lit(1)).isin(0, *ALTERNATIVES), "bad alternatives"),
        F.when((stops < 2) | (stops > MAX_STOPS) | (F.size("points") > MAX_POINTS), "two to twenty stops"),
        F.when(F.size("avoid") > MAX_AVOID, "too many ways to avoid"),
        F.when(_off_map(F.col("points")) | _off_map(F.col("avoid")), "bad coordinate"),
    )


def client_ip(trusted: Column) -> Column:
    """The address a proxy names (its own header, the first forwarded one, the real-ip header), else the socket's."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    named = F.coalesce(some(F.col("cf")), some(F.split_part("xff", F.lit(","), F.lit(1))), some(F.col("real")))
    return F.coalesce(F.when(trusted, named), F.col("socket"))


def route_class(path: Column) -> Column:
    """A path's class for counters: few values, whatever is asked for."""
    out = F.lit("other")
    for prefix, name in reversed((("/api/route", "api/route"), ("/api/geocode", "api/geocode"), ("/api/reverse", "api/reverse"), ("/api/favorites", "api/favorites"), ("/api/history", "api/history"), ("/api/layers/", "api/layers"), ("/map/", "map"))):
        out = F.when(path.startswith(prefix), name).otherwise(out)
    return out


def show_duration(seconds: Column) -> Column:
    """`45 min` or `3 h 05`, to the nearest minute."""
    minutes = F.floor((seconds + 30) / 60)
    long = F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), F.lpad((minutes % 60).cast("string"), 2, "0"))
    return F.when(seconds < 3600, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(long)


def show_distance(metres: Column) -> Column:
    """`850 m` or `12.3 km`."""
    return F.when(metres < 1000, F.concat(metres.cast("long").cast("string"), F.lit(" m"))).otherwise(F.format_string("%.1f km", metres / 1000))


def top_shares(df: DataFrame, by: str, label: str, value: str, least: float = SHARE, top: int = TOP) -> DataFrame:
    """by, label, share, rank: the largest labels of each group by their share of the value."""
    sums = df.groupBy(by, label).agg(F.sum(value).alias("q"))
    whole = Window.partitionBy(by)
    ranked = sums.withColumn("share", F.col("q") / F.sum("q").over(whole)).withColumn("rank", F.row_number().over(whole.orderBy(F.desc("q"), label)))
    return ranked.filter((F.col("share") > least) & (F.col("rank") <= top)).select(by, label, "share", "rank")


def snap_note(distance: Column, refused: Column) -> Column:
    """What to say of a snapped point: far (it was refused), moved (over 150 m), applied, or nothing."""
    return F.when(refused, "far").when(distance > 150, "moved").when(distance > 1e-6, "applied").otherwise("none")
