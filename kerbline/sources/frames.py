"""Poses, telemetry, detections, labels and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geo
from ..session import cut
from .documents import RANGE_BYTES, read_elements

_POSE = """frame_idx int, i int, file string, video_frame int, t_s double, x double, y double, alt double, lat double, lon double, captured_at string,
 yaw double, yaw_src string, roll double, pitch double, cam_pitch double, cam_roll double, cam_yaw double, wp array<double>, standoff boolean, standoff_m double, avoiding boolean, steering boolean"""


def _source_name() -> Column:
    return F.col("_metadata.file_name")


def _named_by(key: str, name: Column) -> Column:
    """What a file is named after: its folder ``<key>=<name>`` when written by us, else ``name``."""
    folder = F.regexp_extract("_metadata.file_path", rf"/{key}=([^/]+)/", 1)
    return F.when(folder != "", F.url_decode(folder)).otherwise(name)


def _stem(c) -> Column:
    base = F.element_at(F.split(c if isinstance(c, Column) else F.col(c), "/"), -1)
    return F.regexp_replace(base, r"\.[^.]*$", "")


def read_poses(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Pose arrays (one document per file, or per line), old and new key for the frame number.

    Attitude that was not recorded stays NULL.
    """
    rows = spark.read.schema(_POSE).option("multiLine", not lines).json(path)
    return rows.withColumn("frame_idx", F.coalesce("frame_idx", "i")).drop("i")


def usable_poses(poses: DataFrame) -> DataFrame:
    return poses.filter("x is not null and yaw is not null")


# Spellings of the telemetry fields, lower case.
TELEMETRY_FIELDS = {
    "lat": ["latitude"],
    "lon": ["longitude", "longtitude"],
    "alt": ["rel_alt", "altitude"],
    "abs_alt": ["abs_alt"],
    "gb_yaw": ["gb_yaw"],
    "gb_pitch": ["gb_pitch"],
    "gb_roll": ["gb_roll"],
    "baro": ["barometer"],
    "frame": ["framecnt"],
}
# A word and the number behind it; a time code's shape; a date with a time of day.
_PAIR = r"([A-Za-z_]+)\s*:?\s*([+-]?\d*\.?\d+)"
_CODE = r"^\d\d:\d\d:\d\d[.,]\d\d\d$"
_MOMENT = r"\d{4}(?:-\d\d){2}[T ]\d\d(?::\d\d){2}(?:[.,]\d+)?"


def _time_code(block: Column) -> Column:
    """The twelve characters before the arrow."""
    return F.right(F.rtrim(F.substring_index(block, "-->", 1)), F.lit(12))


def parse_telemetry(texts: DataFrame, text: str = "value", source: str = "source") -> DataFrame:
    """Subtitle-style telemetry to one row per block that carries a time code.

    Every word with a number is read once per block and fields are looked up by their spellings, the first in the block
    winning.  A GPS triple (longitude first) stands in for missing coordinates; the wall clock is kept apart from the time code.
    """
    coded = F.filter(F.split(text, r"\n\s*\n"), lambda b: b.contains("-->") & _time_code(b).rlike(_CODE))
    blocks = texts.select(source, F.posexplode(coded).alias("block", "raw"))
    flat = F.translate("raw", "\n\r", "  ")
    read = blocks.select(
        source, "block", _time_code(F.col("raw")).alias("t"),
        F.arrays_zip(F.regexp_extract_all(flat, F.lit(_PAIR), F.lit(1)).alias("k"), F.regexp_extract_all(flat, F.lit(_PAIR), F.lit(2)).alias("v")).alias("pairs"),
        F.transform(F.split(F.regexp_extract(flat, r"GPS\s*\(([^)]*)\)", 1), ","), lambda v: F.trim(v).try_cast("double")).alias("gps"),
        F.replace(F.regexp_extract(flat, _MOMENT, 0), F.lit(","), F.lit(".")).try_cast("timestamp_ntz").alias("captured_at"))

    def field(name: str) -> Column:
        return F.get(F.filter("pairs", lambda p: F.lower(p["k"]).isin(TELEMETRY_FIELDS[name])), F.lit(0))["v"].try_cast("double")

    named = read.withColumns({k: field(k) for k in TELEMETRY_FIELDS})
    triple = F.when((F.col("lat").isNull() | F.col("lon").isNull()) & (F.size("gps") == 3), F.col("gps"))
    return named.select(
        source, "block", F.coalesce(F.col("frame").cast("int"), F.col("block")).alias("frame"), "t", "captured_at",
        F.coalesce(F.get(triple, F.lit(1)), "lat").alias("lat"), F.coalesce(F.get(triple, F.lit(0)), "lon").alias("lon"),
        F.coalesce("alt", F.get(triple, F.lit(2))).alias("alt"), "abs_alt", "gb_yaw", "gb_pitch", "gb_roll", "baro")


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Whole telemetry files (one flight is one file) with their name, or that of their folder ``source=<name>``."""
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return text.select(_named_by("source", _source_name()).alias("source"), "value")


def telemetry_to_poses(records: DataFrame) -> DataFrame:
    """Records with a position as poses: compass yaw to heading, downward pitch to ``+pi/2``, absent stays absent."""
    x, y = geo.to_enu("lon", "lat")
    keep = [c for c in ("source", "captured_at") if c in records.columns]
    return records.filter("lat is not null and lon is not null").select(
        *keep, F.col("frame").alias("frame_idx"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.coalesce("baro", "alt", "abs_alt").alias("alt"), "lat", "lon",
        F.radians(F.lit(90.0) - F.col("gb_yaw")).alias("yaw"), F.radians(-F.col("gb_pitch")).alias("cam_pitch"), F.radians("gb_roll").alias("cam_roll"))


_DET = "array<struct<box:array<double>,conf:double>>"


# Where a detection cache keeps its frames: lists under names, the same under ``frames``, or a list of pose and detections.
_CACHES = {("{",): "[", ("{", "{frames"): "[", ("[",): "{"}


def read_detections(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(key, n, x0, y0, x1, y1, conf)`` of detection caches, each file in one of three forms, read by ranges of bytes.

    ``{key: [{box, conf}]}``, the same below ``frames``, or ``[{pose, dets: [[box, conf]]}]``, where the key is the pose's file or
    else its video frame or frame number.  Entries without a box are skipped.
    """
    # both forms read the elements, which are handed out once
    parts = cut(read_elements(spark, path, _CACHES, range_bytes))
    listed = parts.filter("section <> '['").select(F.from_json(F.concat(F.lit('{"'), "name", F.lit('":'), "value", F.lit("}")), f"map<string,{_DET}>").alias("m"))
    named = listed.select(F.explode("m").alias("key", "ds")).select("key", F.posexplode("ds").alias("n", "d")).select("key", "n", "d.box", "d.conf")
    posed = parts.filter("section = '['").select(F.from_json("value", "pose struct<file:string,video_frame:int,frame_idx:int,i:int>, dets array<array<string>>").alias("f"))
    key = F.coalesce("f.pose.file", F.col("f.pose.video_frame").cast("string"), F.coalesce("f.pose.frame_idx", "f.pose.i").cast("string"))
    pairs = posed.select(key.alias("key"), F.posexplode("f.dets").alias("n", "d"))
    pairs = pairs.select("key", "n", F.from_json(F.get("d", F.lit(0)), "array<double>").alias("box"), F.get("d", F.lit(1)).cast("double").alias("conf"))
    return named.unionByName(pairs).filter("box is not null").select("key", "n", *[F.get("box", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], "conf")


def detections_for(poses: DataFrame, dets: DataFrame) -> DataFrame:
    """Detections of each pose, filed under file name, stem, video frame or frame number; the first key present wins."""
    # what a reader hands out is written once for the two joins
    dets = cut(dets)
    keys = F.array(F.col("file"), _stem("file"), F.col("video_frame").cast("string"), F.col("frame_idx").cast("string"))
    cand = poses.select("frame_idx", F.posexplode(keys).alias("rank", "key")).filter("key is not null")
    # keys and detections are as many as the frames: they are merged, as Spark would send all of them round by those few bytes
    hit = cand.join(dets.select("key").distinct().hint("merge"), "key").groupBy("frame_idx").agg(F.min_by("key", "rank").alias("key"))
    return hit.join(dets.hint("merge"), "key")


def _label_name(path: Column) -> Column:
    """Frame a label file belongs to: its folder ``stem=<name>`` when written by us, else the file's own name."""
    folder = F.regexp_extract(path, r"/stem=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(_stem(path))


def read_yolo(spark: SparkSession, path: str, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(boxes, files)`` of a label folder; ``files`` lists empty ones too, so they differ from missing ones.

    ``sizes`` (``stem, w, h``) scales boxes to pixels; lines without exactly five numbers are ignored.
    """
    # Spark's scans skip files of no bytes, so names come from the listing the scan is planned with
    names = spark.read.option("pathGlobFilter", "*.txt").text(path).inputFiles()
    files = spark.createDataFrame([(n,) for n in names], "path string").select(_label_name(F.col("path")).alias("stem")).distinct()
    lines = spark.read.option("pathGlobFilter", "*.txt").text(path).select(_label_name(F.col("_metadata.file_path")).alias("stem"), F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") == 5)
    v = lines.select("stem", *[F.get("f", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(("cls", "cx", "cy", "bw", "bh"))]).filter("cx is not null and cy is not null and bw is not null and bh is not null")
    if sizes is not None:
        v = v.join(sizes.select("stem", "w", "h"), "stem")
    else:
        v = v.withColumns({"w": F.lit(1.0), "h": F.lit(1.0)})
    return v.select("stem", "cls", ((F.col("cx") - F.col("bw") / 2) * F.col("w")).alias("x0"), ((F.col("cy") - F.col("bh") / 2) * F.col("h")).alias("y0"),
                    ((F.col("cx") + F.col("bw") / 2) * F.col("w")).alias("x1"), ((F.col("cy") + F.col("bh") / 2) * F.col("h")).alias("y1")), files


def _rect(x, y, w, h) -> Column:
    return F.array(geo.point(x, y), geo.point(x + w, y), geo.point(x + w, y + h), geo.point(x, y + h))


_COCO = """images array<struct<id:bigint,file_name:string>>, annotations array<struct<image_id:bigint,segmentation:string,bbox:array<double>>>"""
_VGG = "map<string,struct<filename:string,regions:string>>"
_REGION = "struct<shape_attributes:struct<name:string,all_points_x:array<double>,all_points_y:array<double>,x:double,y:double,width:double,height:double>>"


def read_annotations(spark: SparkSession, path: str, fmt: str, sizes: DataFrame | None = None) -> DataFrame:
    """``(frame, ring)`` in pixels from ``coco``, ``vgg``, ``csv`` or ``yolo`` exports."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    if fmt == "coco":
        doc = spark.read.schema(_COCO).option("multiLine", True).json(path)
        names = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), base(F.col("i.file_name")).alias("frame"))
        an = doc.select(F.explode("annotations").alias("a")).select("a.*").withColumn("polys", F.from_json("segmentation", "array<array<double>>"))
        rle = F.coalesce(F.col("segmentation").startswith("{"), F.lit(False))
        poly = an.filter(~rle).select("image_id", F.explode("polys").alias("p"))
        ring = F.transform(F.sequence(F.lit(0), F.floor(F.size("p") / 2).cast("int") - 1), lambda k: geo.point(F.get("p", k * 2), F.get("p", k * 2 + 1)))
        a = poly.filter(F.size("p") >= 6).select("image_id", ring.alias("ring"))
        bare = ~rle & (F.coalesce(F.size("polys"), F.lit(0)) <= 0) & (F.size("bbox") == 4)
        b = an.filter(bare).select("image_id", _rect(*[F.get("bbox", F.lit(i)) for i in range(4)]).alias("ring"))
        return a.unionByName(b).join(names, "image_id", "left").select(F.coalesce("frame", F.lit("?")).alias("frame"), "ring")
    if fmt == "vgg":
        doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", _VGG)).alias("k", "v")).filter("v.filename is not null")
        regions = F.coalesce(F.when(F.col("v.regions").startswith("{"), F.map_values(F.from_json("v.regions", f"map<string,{_REGION}>"))), F.from_json("v.regions", f"array<{_REGION}>"))
        s = doc.select(base(F.col("v.filename")).alias("frame"), F.explode(regions).alias("r")).select("frame", "r.shape_attributes.*")
        poly = F.zip_with("all_points_x", "all_points_y", lambda x, y: geo.point(x, y))
        ring = F.when(F.col("name").isin("polygon", "polyline"), poly).when(F.col("name") == "rect", _rect(F.col("x"), F.col("y"), F.col("width"), F.col("height")))
        return s.select("frame", ring.alias("ring")).filter(F.size("ring") >= 3)
    if fmt == "csv":
        c = spark.read.schema("label string, x string, y string, w string, h string, image string, iw string, ih string").csv(path)
        n = c.select(base(F.col("image")).alias("frame"), *[F.col(k).try_cast("double").alias(k) for k in "xywh"]).filter("frame is not null and x is not null and y is not null and w is not null and h is not null")
        return n.select("frame", _rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("ring"))
    if fmt == "yolo":
        boxes, _ = read_yolo(spark, path, sizes)
        boxes = boxes.filter(~F.col("stem").isin("classes", "labels"))
        return boxes.select(F.col("stem").alias("frame"), _rect(F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("ring"))
    raise ValueError(fmt)


AREA_NAME = r"^[A-Za-z0-9_-]{1,64}$"


def read_labels(spark: SparkSession, folder: str, area: str | None = None) -> DataFrame:
    """``(area, bay_id, gt)`` from ``<area>.ground_truth.json`` files, or any below a folder ``area=<name>``.

    Odd area names are not read, absent ones are empty.
    """
    import re

    if area is not None and not re.fullmatch(AREA_NAME.strip("^$"), area):
        raise ValueError("area name")
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    files = files.filter(_source_name().endswith(".ground_truth.json") | F.col("_metadata.file_path").contains("/area="))
    rows = files.select(_named_by("area", F.regexp_replace(_source_name(), r"\.ground_truth\.json$", "")).alias("area"), F.explode(F.from_json("value", "map<string,boolean>")).alias("bay_id", "gt"))
    rows = rows.filter(F.col("area").rlike(AREA_NAME))
    return rows if area is None else rows.filter(F.col("area") == area)


FLIGHT_LOG = """t double, x double, y double, alt double, yaw double, speed double, wp int, wp_dist double, obst_m double, obst_deg double, raw_m double,
 avoiding int, steering int, side int, v_des double, fwd double, hold int, rho double"""


def read_flight_log(spark: SparkSession, path: str) -> DataFrame:
    """1 Hz flight log; blanks are NULL."""
    return spark.read.schema(FLIGHT_LOG).option("header", True).csv(path)
