"""Queries of text, geometry, grade and request functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import access, codecs, geo, text
from ..operators import requests
from . import query

_FOLD = "trim(regexp_replace(translate(replace(lower({c}), 'ß', 'ss'), 'àáâãäåèéêëìíîïòóôõöùúûüçñ''`´', 'aaaaaaeeeeiiiiooooouuuucn   '), '\\s+', ' ', 'g'))"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "fold_text",
    f"""WITH f AS (SELECT item_id, {_FOLD.format(c="text")} AS folded FROM benchmark)
SELECT item_id, folded, CAST(len(list_filter(string_split_regex(folded, '[^a-z0-9]+'), lambda t: t <> '')) AS BIGINT) AS n_tokens,
  array_to_string(list_sort(list_distinct(list_filter(string_split_regex(folded, '[^a-z0-9]+'), lambda t: t <> ''))), ' ') AS canonical FROM f""",
)
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded text, its tokens and its canonical form."""
    b = _t(spark, sf_dir, "benchmark")
    return b.select("item_id", text.fold(F.col("text")).alias("folded"), F.size(text.tokens(text.fold(F.col("text")))).cast("long").alias("n_tokens"), text.canonical(F.col("text")).alias("canonical"))


_NUMBERS = "CASE p_partkey % 6 WHEN 0 THEN 'E40' || b WHEN 1 THEN 'a0' || b || 't' WHEN 2 THEN '4' || b || 'B' WHEN 3 THEN 'E' || b || 'A-01A' WHEN 4 THEN ' CVO0' || b || ' ' ELSE b || ' / ' || b END"


@query(
    "part_names",
    f"""WITH p AS (SELECT *, {_NUMBERS} AS number FROM (SELECT *, regexp_replace(p_brand, '.*#', '') AS b FROM part)),
f AS (SELECT p_partkey, p_name, p_brand, list_filter([upper(regexp_replace(number, '[^A-Za-z0-9]', '', 'g')), upper(string_split_regex(trim(number), '[^A-Za-z0-9]')[1])], lambda x: x <> '') AS forms FROM p)
SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS shown, CAST(regexp_matches(lower(trim(p_brand)), '^(?:(?:trail|sat|sentiero|cai|avs|weg) )?\\d+[a-z]?$') AS BOOLEAN) AS is_number,
  array_to_string(list_sort(list_distinct(list_filter(list_concat(forms, list_transform(forms, lambda x: CASE WHEN regexp_full_match(x, '[A-Z]?0*[0-9]+[A-Z]*') THEN regexp_extract(x, '^[A-Z]?0*([0-9]+[A-Z]*)$', 1) ELSE '' END)), lambda x: x <> ''))), ' ') AS keys FROM f""",
)
def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trail-number forms made of brands, and names as a sentence shows them."""
    name = F.col("p_name")
    p = _t(spark, sf_dir, "part").withColumn("b", F.regexp_replace("p_brand", ".*#", "")).withColumn("number", F.expr(_NUMBERS))
    return p.select(
        "p_partkey", F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 20)).alias("shown"), text.is_trail_number(F.col("p_brand")).alias("is_number"), F.array_join(text.trail_keys(F.col("number")), " ").alias("keys")
    )


# Spellings of durations, and what they are in seconds and in minutes; -1 where one of the two cannot be read.
_M, _S, _H = "event_id % 60", "event_id % 50", "event_id % 5"
_SPELLINGS = (
    ("{m}", f"({_M}) * 60", f"({_M}) * 60"),
    ("{m}:{ss}", f"({_M}) * 60 + {_S}", f"({_M}) * 60 + {_S}"),
    ("{h}:{mm}:{ss}", f"({_H}) * 3600 + ({_M}) * 60 + {_S}", "-1"),
    ("{h} h {mm}", "-1", f"({_H}) * 60 + {_M}"),
    ("{h}.{mm}", f"CAST(round(({_H}) * 60 + ({_M}) * 0.6e0) AS INTEGER)", f"({_H}) * 60 + {_M}"),
    ("{m} minuti", f"({_M}) * 60", f"{_M}"),
    ("{m},5 mins", f"({_M}) * 60 + 30", "-1"),
    ("{m}'", f"({_M}) * 60", f"{_M}"),
    ("{h} ora", "-1", f"({_H}) * 60"),
    ("{h}:{mm} Min", f"({_H}) * 60 + {_M}", "-1"),
    ("about {m}", "-1", "-1"),
)
_CASE = lambda i: f"CASE event_id % {len(_SPELLINGS)} " + " ".join(f"WHEN {k} THEN {x[i]}" for k, x in enumerate(_SPELLINGS)) + " END"


@query("durations", f"SELECT event_id, CAST({_CASE(1)} AS INTEGER) AS seconds, CAST({_CASE(2)} AS INTEGER) AS minutes FROM events")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published durations in all their spellings, to seconds and to minutes."""
    e = F.col("event_id")
    number = {"m": e % 60, "s": e % 50, "h": e % 5}
    said = {k: v.cast("string") for k, v in number.items()} | {k * 2: F.lpad(v.cast("string"), 2, "0") for k, v in number.items()}
    spelled = F.lit(None).cast("string")
    for k, (form, _, _) in enumerate(_SPELLINGS):
        pieces = [said[p] if p in said else F.lit(p) for p in form.replace("{", "\0").replace("}", "\0").split("\0") if p]
        spelled = F.when(e % len(_SPELLINGS) == k, F.concat(*pieces)).otherwise(spelled)
    return _t(spark, sf_dir, "events").select("event_id", F.coalesce(text.seconds(spelled), F.lit(-1)).alias("seconds"), F.coalesce(text.minutes(spelled), F.lit(-1)).alias("minutes"))


@query(
    "projection",
    """WITH p AS (SELECT c_custkey, 46 + (c_custkey % 97) * 0.01e0 AS lat, 11 + (c_custkey % 89) * 0.013e0 AS lon FROM customer)
SELECT c_custkey, round((lon - 11) * 111412.84e0 * cos(radians(46e0)), 3) AS x, round((46 - lat) * (111132.92e0 - 559.82e0 * cos(2 * radians(46e0))), 3) AS y,
  round(2 * 6371008.8e0 * asin(sqrt(pow(sin(radians(lat - 46) / 2), 2) + cos(radians(46e0)) * cos(radians(lat)) * pow(sin(radians(lon - 11) / 2), 2))), 3) AS metres,
  CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS tile_x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096) AS BIGINT) AS tile_y FROM p""",
)
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local plane, great-circle distance and map tile of made-up coordinates."""
    c = F.col("c_custkey")
    p = _t(spark, sf_dir, "customer").select("c_custkey", (46 + (c % 97) * 0.01).alias("lat"), (11 + (c % 89) * 0.013).alias("lon"))
    lat, lon, lat0, lon0 = F.col("lat"), F.col("lon"), F.lit(46.0), F.lit(11.0)
    x, y = geo.to_plane(lat, lon, lat0, lon0)
    tx, ty = geo.tile(lat, lon, F.lit(12))
    return p.select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(geo.haversine(lat0, lon0, lat, lon), 3).alias("metres"), tx.alias("tile_x"), ty.alias("tile_y"))


@query(
    "utm_round_trip",
    "SELECT c_custkey, true AS near FROM customer",
)
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTM and back, within a hundredth of a millimetre."""
    c = F.col("c_custkey")
    p = _t(spark, sf_dir, "customer").select("c_custkey", (45.5 + (c % 97) * 0.015).alias("lat"), (10 + (c % 89) * 0.03).alias("lon"))
    p = p.withColumns(dict(zip(("e", "n"), geo.to_utm32(F.col("lat"), F.col("lon")), strict=True)))
    lat, lon = geo.from_utm32(F.col("e"), F.col("n"))
    return p.select("c_custkey", ((F.abs(lat - F.col("lat")) < 1e-7) & (F.abs(lon - F.col("lon")) < 1e-7) & F.col("e").between(400000, 800000)).alias("near"))


@query(
    "hilbert_tiles",
    """WITH RECURSIVE t AS (SELECT c_custkey, CAST(7 AS BIGINT) AS z, c_custkey % 128 AS x, c_custkey // 128 % 128 AS y FROM customer),
h AS (
  SELECT c_custkey, x, y, 6 AS k, CAST(0 AS BIGINT) AS d FROM t
  UNION ALL
  SELECT c_custkey, CASE WHEN ry = 1 THEN x WHEN rx = 1 THEN s - 1 - y ELSE y END, CASE WHEN ry = 1 THEN y WHEN rx = 1 THEN s - 1 - x ELSE x END, k - 1, d + s * s * xor(3 * rx, ry)
  FROM (SELECT c_custkey, k, d, CAST(1 AS BIGINT) << k AS s, (x >> k) & 1 AS rx, (y >> k) & 1 AS ry, x & ((CAST(1 AS BIGINT) << k) - 1) AS x, y & ((CAST(1 AS BIGINT) << k) - 1) AS y FROM h WHERE k >= 0))
SELECT c_custkey, d + ((CAST(1 AS BIGINT) << 14) - 1) // 3 AS tile_id FROM h WHERE k = -1""",
)
def hilbert_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive numbers of the tiles of zoom 7."""
    p = _t(spark, sf_dir, "customer").select("c_custkey", F.lit(7).alias("z"), (F.col("c_custkey") % 128).alias("x"), F.expr("c_custkey div 128 % 128").alias("y"))
    return p.select("c_custkey", geo.hilbert_id("z", "x", "y").alias("tile_id"))


@query(
    "polyline_distance",
    """WITH p AS (SELECT s_suppkey, s_suppkey * 337 % 3000 AS px, s_suppkey * 911 % 2000 AS py FROM supplier),
s AS (SELECT * FROM (VALUES (0e0, 0e0, 1000e0, 0e0), (1000e0, 0e0, 1000e0, 800e0), (1000e0, 800e0, 2500e0, 800e0)) v(ax, ay, bx, b_y)),
t AS (SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (b_y - ay)) / (pow(bx - ax, 2) + pow(b_y - ay, 2)))) AS t FROM p, s)
SELECT s_suppkey, round(min(sqrt(pow(px - (ax + t * (bx - ax)), 2) + pow(py - (ay + t * (b_y - ay)), 2))), 6) AS metres,
  any_value(px > 0 AND px < 1000 AND py > 0 AND py < 1000) AS inside FROM t GROUP BY s_suppkey""",
)
def polyline_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to a polyline, and whether a square ring holds the point."""
    k = F.col("s_suppkey")
    xy = lambda pts: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])
    p = _t(spark, sf_dir, "supplier").select(
        "s_suppkey", (k * 337 % 3000).cast("double").alias("px"), (k * 911 % 2000).cast("double").alias("py"), xy([(0, 0), (1000, 0), (1000, 800), (2500, 800)]).alias("line"), xy([(0, 0), (1000, 0), (1000, 1000), (0, 1000), (0, 0)]).alias("ring")
    )
    on_edge = (F.col("px") % 1000 == 0) | (F.col("py") % 1000 == 0)
    return p.select("s_suppkey", F.round(geo.to_line("px", "py", "line"), 6).alias("metres"), (geo.inside("px", "py", "ring") & ~(on_edge & ((F.col("px") == 0) | (F.col("py") == 0)))).alias("inside"))


@query(
    "grades",
    """SELECT p_partkey, CAST(p_partkey % 6 AS INTEGER) AS ordinal, CASE p_partkey % 6 WHEN 5 THEN 6 ELSE CAST(p_partkey % 6 AS INTEGER) END AS ceiling FROM part""",
)
def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade letters, with and without a suffix, to ordinals."""
    names = F.element_at(F.array(F.lit("?"), F.lit("t"), F.lit("E"), F.lit("EE"), F.lit("EEA-PD"), F.lit("A")), (F.col("p_partkey") % 6 + 1).cast("int"))
    o = access.grade_ordinal(names)
    return _t(spark, sf_dir, "part").select("p_partkey", o.alias("ordinal"), access.grade_ceiling(o).alias("ceiling"))


@query(
    "request_errors",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN 'bad mode' WHEN o_orderkey % 19 = 0 THEN 'bad grade' WHEN o_orderkey % 4 = 0 THEN 'bad alternatives' WHEN o_orderkey % 25 < 2 THEN 'two to twenty stops'
  WHEN o_orderkey % 25 > 20 THEN 'two to twenty stops' WHEN o_orderkey % 29 = 0 THEN 'bad coordinate' END AS error FROM orders""",
)
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each made-up request breaks."""
    k = F.col("o_orderkey")
    lat = F.when(k % 29 == 0, F.lit(95.0)).otherwise(F.lit(46.0))
    r = _t(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(k % 23 == 0, "boat").otherwise("car+hike").alias("mode"),
        F.when(k % 19 == 0, "Z").otherwise("EE").alias("grade"),
        F.when(k % 4 == 0, 2).otherwise(3).alias("alternatives"),
        F.when(k % 25 == 0, F.array().cast("array<struct<lat:double,lon:double,via:boolean>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest((k % 25).cast("int"), F.lit(1))), lambda i: F.struct(lat.alias("lat"), F.lit(11.0).alias("lon"), F.lit(False).alias("via")))).alias("points"),
        F.array().cast("array<struct<lat:double,lon:double>>").alias("avoid"),
    )
    return r.select("o_orderkey", requests.error().alias("error"))


@query(
    "client_addresses",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '9.9.9.' || event_id % 250 WHEN event_id % 3 = 1 THEN '8.8.8.' || event_id % 250 ELSE '7.7.7.7' END AS ip,
  CASE event_type WHEN 'view' THEN 'api/route' WHEN 'click' THEN 'map' WHEN 'purchase' THEN 'api/geocode' ELSE 'other' END AS route_class FROM events""",
)
def client_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose request it is behind a proxy, and the class of its path."""
    e = F.col("event_id")
    path = F.when(F.col("event_type") == "view", "/api/route").when(F.col("event_type") == "click", "/map/tiles/1/2/3").when(F.col("event_type") == "purchase", "/api/geocode?q=x").otherwise("/favicon.ico")
    r = _t(spark, sf_dir, "events").select(
        "event_id", path.alias("path"), F.when(e % 3 == 0, F.concat(F.lit(" 9.9.9."), (e % 250).cast("string"))).otherwise("").alias("cf"), F.when(e % 3 == 1, F.concat(F.lit("8.8.8."), (e % 250).cast("string"), F.lit(", 1.1.1.1"))).alias("xff"), F.lit("").alias("real"), F.lit("7.7.7.7").alias("socket")
    )
    return r.select("event_id", requests.client_ip(F.lit(True)).alias("ip"), requests.route_class(F.col("path")).alias("route_class"))


@query(
    "formatted",
    """SELECT l_orderkey, l_linenumber, CASE WHEN t < 1 THEN '< 1 min' WHEN t < 60 THEN t || ' min' WHEN t % 60 = 0 THEN t // 60 || ' h' ELSE t // 60 || ' h ' || t % 60 || ' min' END AS duration,
  CASE WHEN m < 1000 THEN (m + 5) // 10 * 10 || ' m' WHEN m < 10000 THEN printf('%.1f km', m / 1000e0) ELSE (m + 500) // 1000 || ' km' END AS distance,
  '+' || CASE WHEN m >= 10000 THEN m // 1000 || chr(8201) || lpad(CAST(m % 1000 AS VARCHAR), 3, '0') ELSE CAST(m AS VARCHAR) END || ' m' AS ascent
FROM (SELECT l_orderkey, l_linenumber, (CAST(l_quantity * 300 AS BIGINT) - 290 + 30) // 60 AS t, CAST(l_quantity * 311 AS BIGINT) AS m FROM lineitem)""",
)
def formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations and distances as people read them."""
    s, m = (F.col("l_quantity") * 300).cast("long") - 290, (F.col("l_quantity") * 311).cast("long")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", codecs.duration(s.cast("double")).alias("duration"), codecs.distance(m.cast("double")).alias("distance"), codecs.height(m.cast("double"), "+").alias("ascent"))


@query(
    "composition",
    """WITH c AS (SELECT l_orderkey, l_shipmode AS label, sum(l_quantity) AS q FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS l_shipmode, l_quantity FROM lineitem) GROUP BY ALL),
s AS (SELECT *, q / sum(q) OVER (PARTITION BY l_orderkey) AS share, row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC, label) AS k FROM c)
SELECT l_orderkey, label, round(share, 6) AS share, k AS rank FROM s WHERE share > 0.03 AND k <= 3""",
)
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an order is mostly made of: labels over three per cent, three at most."""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("label"), "l_quantity")
    return requests.top_shares(rows, "l_orderkey", "label", "l_quantity").select("l_orderkey", "label", F.round("share", 6).alias("share"), "rank")
