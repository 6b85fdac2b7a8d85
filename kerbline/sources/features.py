"""GeoJSON, map extracts and airspace files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geo
from ..functions.text import PUBLIC_ZONE, blank_to_null, parking_kind
from ..operators.scan import latest_per_key
from .documents import read_elements

_GEOM = {
    "Point": "array<double>", "MultiPoint": "array<array<double>>", "LineString": "array<array<double>>",
    "Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>",
}


def as_points(coords: Column) -> Column:
    """``[[x, y], ...]`` as an array of points."""
    return F.transform(coords, lambda c: geo.point(c[0], c[1]))


def read_features(spark: SparkSession, path: str, geom: str, props: str, whole_files: bool = False) -> DataFrame:
    """One row per feature: ``gtype``, ``coords`` and the typed properties (a DDL string).

    Line-delimited features split freely; ``whole_files`` reads classic one-document collections, by ranges of
    bytes.  Features of other geometry types keep their type but have no coordinates.
    """
    # coordinates stay text until the type is known, as their nesting differs by type
    one = f"type string, properties struct<{props}>, geometry struct<type:string,coordinates:string>"
    if whole_files:
        parts = read_elements(spark, path, {("{", "[features"): "{"})
        rows = parts.select(F.from_json("value", one).alias("f")).select("f.*")
    else:
        rows = spark.read.schema(one).json(path)
    coords = F.from_json(F.when(F.col("geometry.type") == geom, F.col("geometry.coordinates")), _GEOM[geom])
    return rows.filter("properties is not null").select(F.col("geometry.type").alias("gtype"), coords.alias("coords"), "properties.*")


BAY_PROPS = "id:bigint,zona:string,mestopoloz:string,park_txt:string,vid_txt_20:string,bearing_deg:string"


def load_bays(features: DataFrame, order: Column | None = None) -> DataFrame:
    """Bay rows from polygon features: text id, blanks as NULL, public flag, numeric bearing, outline centre.

    Features without an id or that are no polygon are skipped; the last of several with one id stays.
    """
    ring = as_points(F.get("coords", F.lit(0)))
    bearing = F.when(F.col("bearing_deg").rlike(r"^[+-]?\\d+(\\.\\d+)?([eE][+-]?\\d+)?$".replace("\\\\", "\\")), F.col("bearing_deg").cast("double"))
    out = features.filter((F.col("gtype") == "Polygon") & F.col("id").isNotNull() & F.col("coords").isNotNull()).select(
        F.col("id").cast("string").alias("bay_id"), blank_to_null("zona").alias("zona"), blank_to_null("mestopoloz").alias("street"),
        parking_kind(blank_to_null("park_txt")).alias("park_txt"), F.coalesce(F.col("vid_txt_20") == PUBLIC_ZONE, F.lit(False)).alias("is_public"),
        bearing.alias("bearing_deg"), geo.open_ring(ring).alias("ring"), *([order.alias("__o")] if order is not None else [F.monotonically_increasing_id().alias("__o")]))
    last = latest_per_key(out, ["bay_id"], F.col("__o")).drop("__o")
    return last.withColumn("__c", geo.vertex_centroid(F.col("ring"))).withColumns({"x": F.col("__c.x"), "y": F.col("__c.y")}).drop("__c")


RUN_PROPS = "run_id:string,street:string,zona:string,park_txt:string,capacity:bigint,pitch_m:double,length_m:double,bearing_deg:double,verified:boolean,bay_ids:array<string>"


def load_curb_runs(features: DataFrame) -> DataFrame:
    """Kerb rows from line features; only an explicit ``false`` makes a run unverified, missing capacity is 0."""
    return features.filter((F.col("gtype") == "LineString") & F.col("run_id").isNotNull()).select(
        "run_id", blank_to_null("street").alias("street"), blank_to_null("zona").alias("zona"), parking_kind(blank_to_null("park_txt")).alias("park_txt"),
        F.coalesce("capacity", F.lit(0)).cast("bigint").alias("capacity"), "pitch_m", "length_m", "bearing_deg",
        F.coalesce("verified", F.lit(True)).alias("verified"), "bay_ids", as_points(F.col("coords")).alias("line"))


CIRCLE_CORNERS = 48

_ZONE = """features array<struct<identifier:string,name:string,restriction:string,reason:array<string>,message:string,
 applicability:array<struct<permanent:string>>,zoneAuthority:array<struct<name:string,email:string,phone:string,purpose:string,intervalBefore:string>>,
 geometry:array<struct<horizontalProjection:struct<type:string,center:array<double>,radius:double,coordinates:array<array<array<double>>>>,
 lowerLimit:double,upperLimit:double,upperVerticalReference:string>>>>"""


def read_airspace(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per zone volume: closed outline (circles as 48 corners), box, limits, permanence, contact.

    One document per file, or per line with ``lines``.
    """
    z = spark.read.schema(_ZONE).option("multiLine", not lines).json(path).select(F.explode("features").alias("z")).select("z.*", F.posexplode("z.geometry").alias("i", "v"))
    hp = F.col("v.horizontalProjection")
    lon, lat = hp["center"][0], F.get(hp["center"], F.lit(1))
    scale = geo.METRES_PER_DEGREE
    th = F.transform(F.sequence(F.lit(0), F.lit(CIRCLE_CORNERS)), lambda k: 6.283185307179586 * (k % CIRCLE_CORNERS) / CIRCLE_CORNERS)
    rad = F.coalesce(hp["radius"], F.lit(0.0))
    circle = F.transform(th, lambda t: geo.point(lon + rad * F.cos(t) / (scale * F.cos(F.radians(lat))), lat + rad * F.sin(t) / scale))
    outer = as_points(F.get(hp["coordinates"], F.lit(0)))
    closed = F.when(F.get(outer, F.lit(0)) == F.get(outer, F.size(outer) - 1), outer).otherwise(F.concat(outer, F.slice(outer, 1, 1)))
    ring = (F.when((hp["type"] == "Circle") & (F.size(hp["center"]) == 2), circle)
            .when((hp["type"] == "Polygon") & (F.size(outer) >= 4), closed))
    calls = F.filter("zoneAuthority", lambda a: a.purpose == "AUTHORIZATION")
    who = F.coalesce(F.get(calls, F.lit(0)), F.get("zoneAuthority", F.lit(0)))
    out = z.withColumns({"ring": ring, "who": who}).filter("ring is not null").withColumn("bb", geo.bbox(F.col("ring")))
    message = F.trim(F.coalesce("message", F.lit("")))
    return out.select(
        F.concat(F.coalesce("identifier", F.lit("None")), F.lit("#"), F.col("i").cast("string")).alias("zone_id"), "identifier", "name", "restriction", F.coalesce("reason", F.array().cast("array<string>")).alias("reason"),
        F.when(message != "", message).alias("message"), F.col("v.lowerLimit").alias("lower_m"), F.col("v.upperLimit").alias("upper_m"),
        F.col("v.upperVerticalReference").alias("vertical_reference"), F.coalesce(F.exists("applicability", lambda a: a.permanent == "YES"), F.lit(False)).alias("permanent"),
        F.when(hp["type"] == "Circle", hp["radius"]).alias("radius_m"), F.col("who.name").alias("authority"), F.col("who.email").alias("authority_email"), F.col("who.phone").alias("authority_phone"),
        F.nullif(F.col("who.intervalBefore"), F.lit("")).alias("interval_before"), "ring", F.col("bb.x0").alias("min_lon"), F.col("bb.y0").alias("min_lat"), F.col("bb.x1").alias("max_lon"), F.col("bb.y1").alias("max_lat"))


_OSM = "elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"


def read_osm_ways(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Elements of a map extract on disk: ``osm_id, etype, tags, line``."""
    e = spark.read.schema(_OSM).option("multiLine", not lines).json(path).select(F.explode("elements").alias("e"))
    line = F.transform("e.geometry", lambda p: geo.point(p.lon, p.lat))
    return e.select(F.col("e.id").alias("osm_id"), F.col("e.type").alias("etype"), F.coalesce("e.tags", F.create_map().cast("map<string,string>")).alias("tags"), line.alias("line"))


def roads_of(ways: DataFrame) -> DataFrame:
    tag = {k: F.element_at("tags", k) for k in ("name", "highway", "lanes", "oneway")}
    return ways.filter("etype = 'way' and line is not null").select("osm_id", *[c.alias(k) for k, c in tag.items()], "line")


def areas_of(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(areas, skipped counts)``: closed rings tagged as building or green; relations and open ways counted."""
    n = F.size("line")
    closed = (n >= 4) & (F.get("line", F.lit(0)) == F.get("line", n - 1))
    way = (F.col("etype") == "way") & F.col("line").isNotNull()
    tags = {k: F.element_at("tags", k) for k in ("name", "building", "landuse", "leisure", "natural", "height")}
    areas = ways.filter(way & closed).select(
        "osm_id", F.when(F.coalesce(tags["building"], F.lit("")) != "", "building").otherwise("green").alias("kind"), *[c.alias(k) for k, c in tags.items()],
        F.element_at("tags", "building:levels").alias("levels"), F.element_at("tags", "building:min_level").alias("min_levels"), F.col("line").alias("ring"))
    counts = ways.agg(F.count_if(F.col("etype") == "relation").alias("relations"), F.count_if(way & ~closed).alias("open_ways"))
    return areas, counts
