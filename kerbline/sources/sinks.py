"""Writers: GeoJSON and label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scan import global_number


def geojson_geometry(kind: str, points: Column) -> Column:
    """Geometry object of a point array: ``Polygon`` (closed here), ``LineString`` or ``Point`` (first one)."""
    pairs = F.transform(points, lambda p: F.array(p.x, p.y))
    if kind == "Polygon":
        ring = F.when(F.get(pairs, F.lit(0)) == F.get(pairs, F.size(pairs) - 1), pairs).otherwise(F.concat(pairs, F.slice(pairs, 1, 1)))
        coords = F.array(ring)
    elif kind == "LineString":
        coords = pairs
    else:
        coords = F.get(pairs, F.lit(0))
    return F.struct(F.lit(kind).alias("type"), coords.alias("coordinates"))


def features(df: DataFrame, kind: str, points: str, props: list[str], keep: list[Column] | None = None) -> DataFrame:
    """One GeoJSON feature per row in ``value``, beside the columns to ``keep``; properties keep their NULLs."""
    f = F.struct(F.lit("Feature").alias("type"), geojson_geometry(kind, F.col(points)).alias("geometry"), F.struct(*props).alias("properties"))
    return df.select(*(keep or []), F.to_json(f, {"ignoreNullFields": "false"}).alias("value"))


def write_features(df: DataFrame, path: str, kind: str, points: str, props: list[str]) -> None:
    """Line-delimited features, written in parallel."""
    features(df, kind, points, props).write.mode("overwrite").text(path)


def to_feature_collection(df: DataFrame, kind: str, points: str, props: list[str]) -> DataFrame:
    """``(n, value)``: the lines of one FeatureCollection document, in the order of ``n``, for a set of any size.

    A comma and a line feed part a feature from the one before, so features are also lines of their own; an empty set gives an
    empty list.
    """
    spark = df.sparkSession
    body = global_number(features(df, kind, points, props), ["value"], "n")
    body = body.select("n", F.concat(F.when(F.col("n") > 1, ",\n").otherwise(""), F.col("value")).alias("value"))
    frame = spark.createDataFrame([(0, '{"type":"FeatureCollection","features":['), (2**62, "]}")], "n bigint, value string")
    return frame.unionByName(body)


def write_feature_collection(df: DataFrame, path: str, kind: str, points: str, props: list[str]) -> None:
    """The document as text files whose names sort in its order."""
    to_feature_collection(df, kind, points, props).repartitionByRange("n").sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def yolo_lines(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """``(stem, value)`` label lines, six decimals; a frame without boxes gives one row with an empty line.

    ``boxes``: ``stem, x0, y0, x1, y1`` in pixels; ``frames``: ``stem, w, h``.
    """
    j = frames.join(boxes, "stem", "left")
    w, h = F.col("w"), F.col("h")
    line = F.format_string("0 %.6f %.6f %.6f %.6f", (F.col("x0") + F.col("x1")) / 2 / w, (F.col("y0") + F.col("y1")) / 2 / h, (F.col("x1") - F.col("x0")) / w, (F.col("y1") - F.col("y0")) / h)
    return j.select("stem", F.when(F.col("x0").isNull(), "").otherwise(line).alias("value"))


def write_yolo_labels(boxes: DataFrame, frames: DataFrame, path: str) -> None:
    """One folder per frame below ``path``; empty frames get their file too."""
    yolo_lines(boxes, frames).write.mode("overwrite").partitionBy("stem").text(path)
