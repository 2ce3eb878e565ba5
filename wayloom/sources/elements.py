"""Map elements: layers, road columns, junction splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Values of a way's tags by layer, classes by highway value, and scales.
ROAD_CLASS = {
    "motorway": "motorway", "motorway_link": "motorway", "trunk": "trunk", "trunk_link": "trunk", "primary": "primary", "primary_link": "primary",
    "secondary": "secondary", "secondary_link": "secondary", "tertiary": "tertiary", "tertiary_link": "tertiary", "unclassified": "residential", "residential": "residential",
    "living_street": "residential", "road": "residential", "service": "service", "track": "track", "path": "path", "footway": "path", "bridleway": "path", "steps": "path",
    "via_ferrata": "path", "cycleway": "cycleway", "pedestrian": "pedestrian",
}
SAC_SCALE = ("hiking", "mountain_hiking", "demanding_mountain_hiking", "alpine_hiking", "demanding_alpine_hiking", "difficult_alpine_hiking")
LIFTS = ("cable_car", "gondola", "mixed_lift", "chair_lift")
RAILS = ("rail", "light_rail", "narrow_gauge", "funicular", "tram")
ELEMENTS = "type string, id long, tags map<string,string>, nodes array<long>, geometry array<struct<lat:double,lon:double>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Elements of JSON documents {"elements": [...]}; a missing file is an empty table."""
    schema = f"elements array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in ELEMENTS.split(', '))}>>"
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], ELEMENTS)
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("elements"))


def tag(name: str) -> Column:
    return F.coalesce(F.try_element_at("tags", F.lit(name)), F.lit(""))


def layer() -> Column:
    """The layer of a way or area, first match; null if none."""
    value = lambda k: tag(k)
    return (
        F.when(value("aerialway").isin(*LIFTS), "lift")
        .when(value("highway") != "", F.when(value("highway").isin(*ROAD_CLASS), "road"))
        .when(value("railway").isin(*RAILS), "rail")
        .when((value("natural") == "water") | (value("waterway") != ""), "water")
        .when(value("leisure").isin("park", "nature_reserve"), "park")
        .when(value("landuse").isin("farmland", "vineyard", "orchard", "meadow"), "farm")
        .when((value("landuse") == "forest") | (value("natural") == "wood"), "wood")
        .when((value("landuse") != "") | (value("amenity") != ""), "area")
        .when(value("building") != "", "building")
    )


def access(name: str) -> Column:
    """-1 forbidden, 1 allowed, 0 unsaid."""
    return F.when(tag(name).isin("no", "private"), -1).when(tag(name).isin("yes", "designated", "permissive"), 1).otherwise(0)


def road_columns(ways: DataFrame) -> DataFrame:
    """Stretch columns of roads.  A way that is one-way against its direction counts as one-way along it."""
    classes = F.create_map(*[F.lit(x) for kv in ROAD_CLASS.items() for x in kv])
    sac = F.lit(0)
    for i, s in enumerate(SAC_SCALE, 1):
        sac = F.when(tag("sac_scale") == s, i).otherwise(sac)
    mtb = F.regexp_extract(tag("mtb:scale"), r"^\D*(\d)", 1)
    return ways.select(
        "id", "nodes", classes[tag("highway")].alias("cls"), (tag("oneway").isin("yes", "1", "-1", "true") | (tag("junction") == "roundabout")).alias("one_way"),
        tag("name").alias("name"), sac.alias("sac"), F.when(mtb == "", -1).otherwise(F.when(mtb == "0", -1).otherwise(F.expr("try_cast(regexp_extract(coalesce(try_element_at(tags, 'mtb:scale'), ''), '^\\\\D*(\\\\d)', 1) as int)"))).alias("mtb"),
        access("bicycle").alias("bike_access"), access("foot").alias("foot_access"), (tag("highway") == "steps").alias("steps"), ((tag("highway") == "via_ferrata") | (tag("via_ferrata_scale") != "")).alias("ferrata"),
    )


def split_at_junctions(ways: DataFrame) -> DataFrame:
    """way, part, nodes: ways (way, nodes) cut at inner nodes that are used more than once, repeats within a way counting."""
    uses = ways.select("way", F.posexplode("nodes").alias("i", "node"), F.size("nodes").alias("n"))
    shared = uses.groupBy("node").agg(F.count("*").alias("uses"))
    marked = uses.join(shared, "node").withColumn("cut", (F.col("i") > 0) & (F.col("i") < F.col("n") - 1) & (F.col("uses") > 1))
    along = Window.partitionBy("way").orderBy("i")
    placed = marked.withColumn("part", F.coalesce(F.sum(F.col("cut").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # A cut node ends one part and begins the next.
    both = placed.select("way", "i", "node", F.explode(F.when(F.col("cut"), F.array("part", F.col("part") + 1)).otherwise(F.array("part"))).alias("part"))
    return both.groupBy("way", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "node"))), lambda x: x["node"]).alias("nodes")).filter("size(nodes) > 1")
