"""Audits and reports over geometry, detections and flights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geo
from ..functions.numeric import axis_diff, count_if, ratio
from ..functions.text import norm_street, parking_kind
from ..session import cut
from .components import link_points
from .spatial import box_pairs, cell, closest_road, near_pairs, nearest
from .stats import percentiles


def view_scatter(points: DataFrame, r: float = 2.0, min_views: int = 3) -> DataFrame:
    """Spread of the ground points of one car over its views: clusters, median and p90 of their rms."""
    m = cut(link_points(points, r))
    looks = m.groupBy("label", "view").agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in (
        ("sx", F.col("x")), ("sy", F.col("y")))])
    mid = looks.groupBy("label").agg(F.count(F.lit(1)).alias("views"), (F.sum("sx") / F.sum("n")).alias("mx"), (F.sum("sy") / F.sum("n")).alias("my")).filter(F.col("views") >= min_views)
    off = m.join(mid, "label").withColumn("sq", (F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)
    rms = off.groupBy("label").agg(F.sqrt(F.avg("sq")).alias("rms"))
    return percentiles(rms, [], "rms", {"median_m": (0.5, "upper_median"), "p90_m": (0.9, "nearest")}, extra=[F.max("size").cast("bigint").alias("clusters")])


# ---- street graph ------------------------------------------------------------

SNAP_M = 0.5


def street_graph(pieces: DataFrame, snap_m: float = SNAP_M) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of straight pieces ``ax, ay, bx, by``; ends snap to a half-metre lattice.

    Pieces that collapse to one node are dropped and parallel pieces keep the shortest length.
    """
    def node(x, y):
        gx, gy = F.bround(F.col(x) / snap_m).cast("bigint"), F.bround(F.col(y) / snap_m).cast("bigint")
        return F.concat_ws(":", gx.cast("string"), gy.cast("string"))

    e = pieces.select(node("ax", "ay").alias("p"), node("bx", "by").alias("q"), geo.distance("ax", "ay", "bx", "by").alias("len")).filter("p <> q")
    edges = e.groupBy(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).agg(F.min("len").alias("len"))
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), edges


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    from .serve import side_by_side

    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), count_if(F.col("degree") % 2 == 1).alias("odd_nodes"), F.max("degree").alias("max_degree"))
    return side_by_side(n, edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("len"), F.lit(0.0)).alias("length_m")))


# ---- geometry audits ---------------------------------------------------------

FAR_M, SKEW_DEG = 15.0, 25.0


def bay_audit(bays: DataFrame, roads: DataFrame, buildings: DataFrame, far_m: float = FAR_M, skew_deg: float = SKEW_DEG, size: float = 40.0) -> DataFrame:
    """Each bay against the map: distance to and angle with the nearest road, building below it, name agreement."""
    # outlines are read by every part below, so they are written once
    bays = cut(bays.withColumns({"__axis": geo.long_axis_deg(F.col("ring")), "__ls": geo.long_short(geo.open_ring(F.col("ring")))}))
    buildings = cut(buildings.select(F.col("ring").alias("__bring"), geo.bbox(F.col("ring")).alias("bb")))
    road = closest_road(bays, roads).select("bay_id", F.col("dist").alias("road_m"), "bearing_deg", F.col("name").alias("road"))
    under = near_pairs(bays.select("bay_id", "x", "y"), buildings,
                       "x", "y", ("bb.x0", "bb.y0", "bb.x1", "bb.y1"), 0.0, size)
    under = under.filter(geo.point_in_ring("x", "y", F.col("__bring"))).select("bay_id").distinct().withColumn("__in", F.lit(True))
    j = bays.join(road, "bay_id", "left").join(under, "bay_id", "left")
    diff = axis_diff(F.col("__axis"), F.pmod(F.col("bearing_deg"), F.lit(180.0)))
    skew = F.when(parking_kind("park_txt") == "parallel", diff).otherwise(axis_diff(diff, F.lit(90.0)))
    out = j.select("bay_id", "street", "park_txt", F.round("road_m", 2).alias("road_m"), "road", F.round(skew, 1).alias("skew_deg"),
                   F.round("__ls.long_m", 2).alias("long_m"), F.round("__ls.short_m", 2).alias("short_m"), F.coalesce("__in", F.lit(False)).alias("in_building"),
                   (F.coalesce(norm_street("road"), F.lit("")) != F.lit("")).alias("__named"),
                   (norm_street("road") == norm_street("street")).alias("__same"))
    flag = F.col("in_building") | F.coalesce(F.col("road_m") > far_m, F.lit(True)) | F.coalesce(F.col("skew_deg") > skew_deg, F.lit(False))
    return out.withColumn("name_ok", F.col("__named") & F.col("__same")).withColumn("flagged", flag).drop("__named", "__same")


def audit_report(audit: DataFrame, by: str = "street", min_group: int = 10) -> DataFrame:
    """Per group: bays, road distance median and p90, skew median, flagged share; worst first, small groups out."""
    # three parts read the audit, whose search for roads is the work
    audit = cut(audit.select(by, "road_m", "skew_deg", "in_building", "flagged"))
    n = audit.groupBy(by).agg(F.count(F.lit(1)).alias("bays"), count_if(F.col("in_building")).alias("in_building"), count_if(F.col("flagged")).alias("flagged"))
    n = n.filter(F.col("bays") >= min_group)
    d = percentiles(audit, [by], "road_m", {"road_p50": (0.5, "nearest"), "road_p90": (0.9, "nearest")})
    s = percentiles(audit, [by], "skew_deg", {"skew_p50": (0.5, "nearest")})
    out = n.join(d, by, "left").join(s, by, "left").withColumn("flag_share", F.col("flagged") / F.col("bays"))
    return out.orderBy(F.col("flag_share").desc(), F.col("bays").desc(), F.col(by))


def distance_histogram(audit: DataFrame, column: str = "road_m", width: float = 5.0, last: int = 7) -> DataFrame:
    """Bays per ``width`` metres, everything from ``last`` widths on, and what has no distance, in one bin."""
    return audit.groupBy(F.coalesce(F.least(F.floor(F.col(column) / width), F.lit(last)), F.lit(last)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("bays"))


def geometry_diff(old: DataFrame, new: DataFrame, turned_deg: float = 5.0, moved_m: float = 1e-6) -> DataFrame:
    """Per street: bays whose centre moved and whose direction changed between two versions."""
    def facts(df, p):
        c = geo.vertex_centroid(geo.open_ring(F.col("ring")))
        return df.select("bay_id", *(["street"] if p == "n" else []), c.x.alias(f"{p}x"), c.y.alias(f"{p}y"), geo.long_axis_deg(F.col("ring")).alias(f"{p}a"))

    j = facts(old, "o").join(facts(new, "n"), "bay_id")
    d = geo.distance("ox", "oy", "nx", "ny")
    return j.groupBy("street").agg(F.count(F.lit(1)).alias("bays"), count_if(d > moved_m).alias("moved"), F.max(d).alias("max_moved_m"),
                                   count_if(axis_diff("oa", "na") > turned_deg).alias("turned"))


def rect_vs_ring_error(bays: DataFrame, tolerance_m: float = 0.05) -> DataFrame:
    """Per area: worst corner distance between the stored outline and the rectangle rebuilt from its bearing."""
    made = geo.bay_rectangle("x", "y", "deg", "park_txt")
    # the outline is opened once, not for every corner
    err = geo.let(geo.open_ring(F.col("ring")), lambda rg: F.array_max(F.transform(made, lambda p: F.array_min(F.transform(rg, lambda q: geo.distance(p.x, p.y, q.x, q.y))))))
    return bays.withColumn("__e", err).groupBy("zona").agg(F.count(F.lit(1)).alias("bays"), F.max("__e").alias("worst_m"), count_if(F.col("__e") > tolerance_m).alias("off"))


def pair_by_position(a: DataFrame, b: DataFrame, max_m: float = 6.0) -> DataFrame:
    """Outlines of one pass paired with the nearest of another, offset split along and across the bay."""
    # most find theirs at half that distance; those are settled by one look around
    near = nearest(a, b, "bay_id", "other_id", "x", "y", "x", "y", limit=max_m, size=max_m / 2)
    turned = a.select("bay_id", "x", "y", F.explode(F.array(F.radians(geo.long_axis_deg(F.col("ring"))))).alias("th"))
    th = F.col("th")
    # a row per outline on every side: they are merged, however few bytes the files are
    j = near.join(turned.hint("merge"), "bay_id").join(b.select("other_id", F.col("x").alias("ox"), F.col("y").alias("oy")).hint("merge"), "other_id")
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    return j.select("bay_id", "other_id", "dist", F.abs(dx * F.cos(th) + dy * F.sin(th)).alias("along_m"), F.abs(dy * F.cos(th) - dx * F.sin(th)).alias("across_m"),
                    (F.col("bay_id") == F.col("other_id")).alias("same_id"))


def pair_agreement(pairs: DataFrame) -> DataFrame:
    pairs = cut(pairs.select("along_m", "across_m", "same_id"))
    n = pairs.agg(F.count(F.lit(1)).alias("pairs"), count_if(F.col("same_id")).alias("same_id"))
    from .serve import side_by_side

    p = [percentiles(pairs, [], c, {f"{c}_p50": (0.5, "nearest"), f"{c}_p90": (0.9, "nearest")}) for c in ("along_m", "across_m")]
    return side_by_side(n, *p)


# ---- detections --------------------------------------------------------------

def unassigned_report(dets: DataFrame, rejected: DataFrame, bays: DataFrame, radius: float = 3.0, size: float = 12.0) -> DataFrame:
    """One row on rejected detections: share, distance to the nearest bay, and how many a wider rule would place.

    ``rejected`` carries ``nearest_m``; ``inside`` counts those that lie in some bay outline.
    """
    from .serve import side_by_side
    from .spatial import points_in_areas

    rejected = cut(rejected)
    total = dets.agg(F.count(F.lit(1)).alias("detections"))
    counts = rejected.agg(F.count(F.lit(1)).alias("unmatched"), count_if(F.col("nearest_m") <= 2 * radius).alias("within_2r"),
                          count_if(F.col("nearest_m") <= 3.0).alias("within_3m"), count_if(F.col("nearest_m") <= 5.0).alias("within_5m"))
    inside = points_in_areas(rejected.select("event_id", "x", "y"), bays.select("ring"), "x", "y", size=size).select("event_id").distinct().agg(F.count(F.lit(1)).alias("inside"))
    p = percentiles(rejected, [], "nearest_m", {"nearest_p10": (0.1, "truncate"), "nearest_p50": (0.5, "truncate"), "nearest_p90": (0.9, "truncate")})
    return side_by_side(total, counts, inside, p).withColumn("unmatched_share", F.round(ratio("unmatched", "detections"), 4))


def class_breakdown(dets: DataFrame, top: int = 12) -> DataFrame:
    """Most frequent classes with median and greatest confidence."""
    n = dets.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.max("conf").alias("conf_max"))
    p = percentiles(dets, ["cls"], "conf", {"conf_p50": (0.5, "upper_median")})
    return n.join(p, "cls").orderBy(F.col("n").desc(), F.col("cls")).limit(top)


def frame_overview(frames: DataFrame, dets: DataFrame) -> DataFrame:
    """Detections per frame, frames without any and median box size."""
    from .serve import side_by_side

    per = frames.select("frame").distinct().join(dets.groupBy("frame").agg(F.count(F.lit(1)).alias("n")), "frame", "left")
    a = per.agg(F.count(F.lit(1)).alias("frames"), count_if(F.col("n").isNull()).alias("empty_frames"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("detections"))
    b = dets.withColumns({"__w": F.col("x1") - F.col("x0"), "__h": F.col("y1") - F.col("y0")})
    return side_by_side(a, percentiles(b, [], "__w", {"w_p50": (0.5, "upper_median")}), percentiles(b, [], "__h", {"h_p50": (0.5, "upper_median")}))


def offset_grid_search(dets: DataFrame, bays: DataFrame, reach: float = 8.0, step: float = 0.5, radius: float = 3.0, size: float = 12.0) -> DataFrame:
    """Every shift of the detections on a grid: median distance to the nearest bay and hits within ``radius``."""
    n = int(round(reach / step))
    steps = [i * step for i in range(-n, n + 1)]
    ticks = F.array(*[F.lit(v) for v in steps])
    # equal detections are one row with their number, whatever their shifts meet
    spots = dets.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    sites = bays.select(F.col("x").alias("bx"), F.col("y").alias("by")).distinct()
    # a spot meets the bays around it once; a pair tells the distances under all shifts, a row per step east with those north beside each other
    pairs = near_pairs(spots, sites, "x", "y", ("bx", "by", "bx", "by"), size + n * step, size + n * step).withColumn("dx", F.explode(ticks))
    least = [F.min(geo.distance(F.col("x") + F.col("dx"), F.col("y") + F.lit(dy), "bx", "by")) for dy in steps]
    around = pairs.groupBy("x", "y", "dx").agg(F.array(*least).alias("d"))
    looked = cut(spots.withColumn("dx", F.explode(ticks)).join(around, ["x", "y", "dx"], "left"))
    every = looked.select("x", "y", "n", "dx", "d", F.posexplode(ticks).alias("i", "dy")).select("x", "y", "n", "dx", "dy", F.get("d", F.col("i")).alias("dist"))
    # a distance up to ``size`` is the least of all; shifts that have none search on
    near = every.filter(F.col("dist") <= size).select("dx", "dy", "dist", "n")
    far = every.filter(F.col("dist").isNull() | (F.col("dist") > size)).select(F.struct("x", "y", "dx", "dy", "n").alias("pid"), (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    far = cut(far)
    if not far.isEmpty():
        near = near.unionByName(nearest(far, bays, "pid", "bay_id", "x", "y", "x", "y").select("pid.dx", "pid.dy", "dist", "pid.n"))
    # what is counted and ranked is the number of detections at a distance
    near = cut(near.groupBy("dx", "dy", "dist").agg(F.sum("n").alias("n")))
    hits = near.groupBy("dx", "dy").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("dist") <= radius, F.col("n"))), F.lit(0)).alias("hits"))
    return hits.join(percentiles(near, ["dx", "dy"], "dist", {"median_m": (0.5, "upper_median")}, weight="n"), ["dx", "dy"])


def raster_shift_search(paint: DataFrame, marks: DataFrame, cell_m: float, reach: float) -> DataFrame:
    """Cells two point sets share when the second is shifted by whole cells up to ``reach``."""
    n = int(round(reach / cell_m))

    def cells(df):
        return df.select(cell("x", cell_m).alias("i"), cell("y", cell_m).alias("j")).distinct()

    ticks = F.array(*[F.lit(i).cast("bigint") for i in range(-n, n + 1)])
    moved = cells(marks).withColumn("di", F.explode(ticks)).withColumn("dj", F.explode(ticks)).select("di", "dj", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
    # dealt by cell after the shifts, so that Spark measures all of them before it chooses a join
    return moved.repartition("i", "j").join(cells(paint), ["i", "j"]).groupBy("di", "dj").agg(F.count(F.lit(1)).alias("overlap"))


def error_by_cause(results: DataFrame, bays: DataFrame, buildings: DataFrame, near_m: float = 3.0, size: float = 40.0) -> DataFrame:
    """Error rate of labelled bays by what surrounds them; a bay belongs to the first cause that fits.

    Causes in order: inside a building, near one, outline shared with an occupied bay, ordinary.
    """
    # outlines are read by every test below, so they are written once
    bays = cut(bays.select("bay_id", "x", "y", "ring"))
    bb = cut(buildings.select(F.col("ring").alias("__bring"), geo.bbox(F.col("ring")).alias("bb")))
    close = near_pairs(bays.select("bay_id", "x", "y"), bb, "x", "y", ("bb.x0", "bb.y0", "bb.x1", "bb.y1"), near_m, size)
    d = close.groupBy("bay_id").agg(F.min(geo.ring_distance("x", "y", F.col("__bring"))).alias("bd"))
    boxed = bays.select("bay_id", "ring", geo.bbox(F.col("ring")).alias("bx"))
    taken = boxed.join(results.filter("gt").select("bay_id"), "bay_id", "left_semi").select(F.col("bay_id").alias("other"), F.col("ring").alias("oring"), F.col("bx").alias("ob"))
    corner = ("x0", "y0", "x1", "y1")
    hit = box_pairs(boxed, taken, tuple(f"bx.{c}" for c in corner), tuple(f"ob.{c}" for c in corner), 12.0)
    hit = hit.filter((F.col("bay_id") != F.col("other")) & geo.rings_overlap(F.col("ring"), F.col("oring"))).select("bay_id").distinct().withColumn("__ov", F.lit(True))
    j = results.filter("gt is not null").join(d, "bay_id", "left").join(hit, "bay_id", "left")
    cause = (F.when(F.col("bd") == 0, "inside building").when(F.col("bd") <= near_m, "near building").when(F.col("__ov"), "overlaps occupied").otherwise("ordinary"))
    wrong = F.col("occupied") != F.col("gt")
    return j.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("bays"), count_if(wrong).alias("errors"), F.round(ratio(count_if(wrong), F.count(F.lit(1))), 4).alias("error_rate"))


def accuracy_outside(causes: DataFrame, excluded: str = "inside building") -> DataFrame:
    kept = causes.filter(F.col("cause") != excluded)
    return kept.agg(F.sum("bays").alias("bays"), F.round(1 - ratio(F.sum("errors"), F.sum("bays")), 4).alias("accuracy"))
