"""Progress along a route: what is left of legs and of a height profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Samples a drawn profile has, and what counts as off the route and as arrived.
SAMPLES, OFF_ROUTE_M, ARRIVED_M = 400, 50.0, 30.0


def remaining_ascent(profile: str, along: str) -> Column:
    """The climb ahead in an array of structs m, e past `along`, from the height interpolated there; null with fewer than two samples."""
    return F.expr(
        f"""if(size({profile}) < 2, null, transform(array(struct(filter({profile}, v_ -> v_.m > {along}) as ahead, filter({profile}, v_ -> v_.m <= {along}) as behind)), s_ ->
          if(size(s_.ahead) = 0, 0D,
            aggregate(s_.ahead,
              named_struct('last', case when size(s_.behind) = 0 then s_.ahead[0].e
                when s_.ahead[0].m > element_at(s_.behind, -1).m
                then element_at(s_.behind, -1).e + (s_.ahead[0].e - element_at(s_.behind, -1).e) * (({along} - element_at(s_.behind, -1).m) / (s_.ahead[0].m - element_at(s_.behind, -1).m))
                else element_at(s_.behind, -1).e end, 'up', 0D),
              (a_, v_) -> named_struct('last', v_.e, 'up', a_.up + greatest(v_.e - a_.last, 0D)), a_ -> a_.up)))[0])"""
    )


def thinned(profile: str, most: int = SAMPLES) -> Column:
    """Every k-th sample and the last, about `most` in all."""
    step = f"greatest(1, size({profile}) div {most})"
    return F.expr(f"filter({profile}, (v_, i_) -> i_ % ({step}) = 0 or i_ = size({profile}) - 1)")


def leg_ends(legs: str, total: str) -> Column:
    """Where each leg (structs with meters) ends along a route of `total` metres; legs are scaled to it."""
    whole = f"aggregate({legs}, 0D, (a, l) -> a + l.meters)"
    return F.expr(f"transform({legs}, (l, i) -> aggregate(slice({legs}, 1, i + 1), 0D, (a, x) -> a + x.meters) * if({whole} > 0, {total} / {whole}, 1D))")


def leg_at(ends: str, along: str) -> Column:
    """Index of the leg at a place: the first that ends behind it, or else the last; null without legs."""
    return F.expr(f"if(size({ends}) = 0, null, coalesce(array_min(filter(transform({ends}, (e, i) -> if({along} < e, i, null)), i -> i is not null)), size({ends}) - 1))")


def remaining_seconds(legs: str, ends: str, along: str) -> Column:
    """Seconds left: of the leg one is on the part that is left, of later ones all."""
    start = f"if(i = 0, 0D, {ends}[i - 1])"
    left = f"if({ends}[i] > {start}, ({ends}[i] - greatest({along}, {start})) / ({ends}[i] - {start}), 1D)"
    return F.expr(f"aggregate(transform({legs}, (l, i) -> if({along} >= {ends}[i], 0D, {left} * l.seconds)), 0D, (a, x) -> a + x)")


def off_route(to_line: Column, accuracy: Column) -> Column:
    """Whether a position is off the line, given how exact the position is."""
    return to_line > F.greatest(F.coalesce(F.nanvl(accuracy, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) + OFF_ROUTE_M


def arrived(to_end: Column, along: Column, total: Column) -> Column:
    return (to_end <= ARRIVED_M) | (along >= total - ARRIVED_M)


def via_position(anchors: str, along: str) -> Column:
    """Before which of a request's points a new one goes: the first that lies past it, never the first of all, or else the last."""
    return F.expr(
        f"""transform(array(coalesce(array_min(filter(transform({anchors}, (a, i) -> if(a > {along}, i, null)), i -> i is not null)), 0)), k -> if(k <= 0, size({anchors}) - 1, k))[0]"""
    )
