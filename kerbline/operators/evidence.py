"""Frames, bays and detections: who sees what, and which detection means which bay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo
from ..functions.geo import Camera
from ..session import cut, spread
from .scan import latest_per_key
from .spatial import box_pairs, near_pairs, nearest

ATTITUDE = ("roll", "pitch", "cam_pitch", "cam_roll")
ASSIGN_M = 3.0


def with_axes(poses: DataFrame) -> DataFrame:
    """Camera axes once per pose, before any join multiplies the rows."""
    have = [a if a in poses.columns else None for a in ATTITUDE]
    return spread(poses.filter("x is not null and y is not null and yaw is not null"), "frame_idx").withColumn("axes", geo.camera_axes("yaw", *have))


def _pose(prefix: str = "p") -> dict[str, Column]:
    return {k: F.col(f"{prefix}.{k}") for k in ("x", "y", "alt", "yaw")}


def frame_bay_views(poses: DataFrame, bays: DataFrame, cam: Camera, mode: str = "full", size: float = 30.0) -> DataFrame:
    """``(frame_idx, bay_id, x, y, px, off, fully)`` of bays in shot; ``px`` is the outline's pixel box.

    ``mode="full"`` wants every corner inside the picture, ``"partial"`` any overlap.  ``off`` is the
    distance of the outline's centre from the picture's centre in pixels.
    """
    p = with_axes(poses).select("frame_idx", F.struct("x", "y", "alt", "yaw", "axes").alias("p"))
    reach = cam.reach(F.col("p.alt"))
    p = p.withColumns({"__a": F.col("p.x") - reach, "__b": F.col("p.y") - reach, "__c": F.col("p.x") + reach, "__d": F.col("p.y") + reach})
    # outlines are laid out once for the pairing and its sizes
    b = cut(bays.select("bay_id", "x", "y", geo.open_ring(F.col("ring")).alias("open"), geo.bbox(F.col("ring")).alias("bb")))
    pair = box_pairs(p, b, ("__a", "__b", "__c", "__d"), ("bb.x0", "bb.y0", "bb.x1", "bb.y1"), size)
    if mode == "full":
        pair = pair.filter(geo.may_be_in_shot(F.col("bb"), _pose(), F.col("p.axes"), cam))
    # the outline is projected once per candidate and reduced to its extent; what a generator makes is not copied into later uses
    ring_px = F.transform("open", lambda v: geo.project(v.x, v.y, _pose(), F.col("p.axes"), cam))
    shot = pair.select("frame_idx", "bay_id", "x", "y", F.explode(F.array(geo.extent(ring_px))).alias("px")).withColumn("fully", geo.fully_in_shot(F.col("px"), cam))
    shot = shot.filter(F.col("fully") if mode == "full" else geo.overlaps_frame(F.col("px"), cam))
    mid_u, mid_v = F.col("px.sx") / F.col("px.n"), F.col("px.sy") / F.col("px.n")
    return shot.select("frame_idx", "bay_id", "x", "y", F.struct("px.x0", "px.y0", "px.x1", "px.y1").alias("px"),
                       geo.distance(mid_u, mid_v, F.lit(cam.w / 2.0), F.lit(cam.h / 2.0)).alias("off"), "fully")


def ground_points(dets: DataFrame, poses: DataFrame, cam: Camera, box: tuple = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """Detections placed on the ground by their box centre; boxes looking above the horizon drop out."""
    p = with_axes(poses).select("frame_idx", F.struct("x", "y", "alt", "yaw", "axes").alias("p"))
    x0, y0, x1, y1 = [F.col(c) for c in box]
    g = geo.unproject((x0 + x1) / 2, (y0 + y1) / 2, _pose(), F.col("p.axes"), cam)
    out = dets.join(p, "frame_idx").withColumn("__g", g).filter("__g is not null")
    return out.withColumns({"x": F.col("__g.x"), "y": F.col("__g.y")}).drop("p", "__g")


def ground_quads(dets: DataFrame, poses: DataFrame, cam: Camera) -> DataFrame:
    """Add ``quad``, the four box corners on the ground, for boxes that all come down."""
    p = with_axes(poses).select("frame_idx", F.struct("x", "y", "alt", "yaw", "axes").alias("p"))
    corners = F.array(*[geo.unproject(F.col(u), F.col(v), _pose(), F.col("p.axes"), cam) for u, v in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    return dets.join(p, "frame_idx").withColumn("quad", corners).filter(~F.exists("quad", lambda c: c.isNull())).drop("p")


def _in_range(dets: DataFrame, views: DataFrame, radius: float) -> DataFrame:
    """Detection x visible bay of the same frame within ``radius``."""
    v = views.select("frame_idx", "bay_id", F.col("x").alias("bx"), F.col("y").alias("by"))
    d = dets.select("event_id", "frame_idx", "x", "y", "conf")
    pair = near_pairs(d, v, "x", "y", ("bx", "by", "bx", "by"), radius, 2 * radius, on=["frame_idx"])
    return pair.withColumn("dist", geo.distance("x", "y", "bx", "by")).filter(F.col("dist") <= radius)


def assign_inclusive(dets: DataFrame, views: DataFrame, radius: float = ASSIGN_M) -> DataFrame:
    """A visible bay is occupied when any detection lands within ``radius`` of its centre."""
    hit = _in_range(dets, views, radius).groupBy("frame_idx", "bay_id").agg(F.max("conf").alias("det_score"))
    return views.select("frame_idx", "bay_id", "off").join(hit, ["frame_idx", "bay_id"], "left").withColumn("occupied", F.col("det_score").isNotNull())


def assign_nearest(dets: DataFrame, views: DataFrame, radius: float = ASSIGN_M) -> DataFrame:
    """Each detection claims only its nearest visible bay in range."""
    claim = _in_range(dets, views, radius).groupBy("event_id", "frame_idx").agg(F.min(F.struct("dist", "bay_id", "conf")).alias("b"))
    hit = claim.groupBy("frame_idx", F.col("b.bay_id").alias("bay_id")).agg(F.max("b.conf").alias("det_score"))
    return views.select("frame_idx", "bay_id", "off").join(hit, ["frame_idx", "bay_id"], "left").withColumn("occupied", F.col("det_score").isNotNull())


def unassigned(dets: DataFrame, views: DataFrame, bays: DataFrame, radius: float = ASSIGN_M, size: float = 12.0) -> DataFrame:
    """Detections no visible bay took, with the nearest bay of all."""
    taken = _in_range(dets, views, radius).select("event_id").distinct()
    left = cut(dets.join(taken, "event_id", "left_anti"))
    near = nearest(left, bays, "event_id", "bay_id", "x", "y", "x", "y", size=size)
    return left.join(near.select("event_id", F.col("bay_id").alias("nearest_bay"), F.col("dist").alias("nearest_m")), "event_id", "left")


def view_distances(dets: DataFrame, views: DataFrame, radius: float) -> DataFrame:
    """Closest detection per visible bay under both rules: ``near_any`` and ``near_own``."""
    pair = _in_range(dets, views, radius)
    any_ = pair.groupBy("frame_idx", "bay_id").agg(F.min("dist").alias("near_any"))
    own = pair.groupBy("event_id", "frame_idx").agg(F.min(F.struct("dist", "bay_id")).alias("b")).groupBy(
        "frame_idx", F.col("b.bay_id").alias("bay_id")).agg(F.min("b.dist").alias("near_own"))
    k = ["frame_idx", "bay_id"]
    return views.select(*k).join(any_, k, "left").join(own, k, "left")


def best_view(views: DataFrame) -> DataFrame:
    """Per bay the frame that shows it whole and closest to the centre."""
    return latest_per_key(views.filter("fully").select("bay_id", "frame_idx", "off"), ["bay_id"], F.struct("off", "frame_idx"), newest=False)


def crop_windows(views: DataFrame, labels: DataFrame) -> DataFrame:
    """Integer pixel boxes of bays wholly in shot, with their label."""
    whole = views.filter("fully")
    px = {"x0": F.floor("px.x0"), "y0": F.floor("px.y0"), "x1": F.floor("px.x1") + 1, "y1": F.floor("px.y1") + 1}
    return whole.join(labels.select("bay_id", "occupied"), "bay_id").select(
        "frame_idx", "bay_id", *[c.cast("int").alias(n) for n, c in px.items()], F.when(F.col("occupied"), "occupied").otherwise("free").alias("label"))


def pair_stills_poses(stills: DataFrame, poses: DataFrame, fps: float, hz: float, start: int = 0, end: int | None = None) -> DataFrame:
    """Every ``round(fps/hz)``-th video frame with the pose recorded under that frame's 1-based number."""
    step = max(1, int(round(fps / hz)))
    kept = stills.filter((F.col("idx") >= start) & (F.pmod(F.col("idx") - start, F.lit(step)) == 0))
    if end is not None:
        kept = kept.filter(F.col("idx") < end)
    p = poses.withColumnRenamed("video_frame", "__n")
    return kept.join(p, F.col("idx") + 1 == F.col("__n"), "left").drop("__n")


def car_boxes(cars: DataFrame, poses: DataFrame, cam: Camera, min_visible: float = 0.55, min_px: float = 8.0, size: float = 30.0) -> DataFrame:
    """Pixel boxes of parked cars (ground outline and roof), cut to the picture.

    ``cars``: ``car_id, x, y, ang, len, wid, height``.  Boxes too small or too much out of shot are dropped.
    """
    p = with_axes(poses).select("frame_idx", F.struct("x", "y", "alt", "yaw", "axes").alias("p"))
    # a roof leans outwards, so look one car height farther than the ground footprint
    reach = cam.reach(F.col("p.alt")) * 1.3 + 6.0
    p = p.withColumns({"__a": F.col("p.x") - reach, "__b": F.col("p.y") - reach, "__c": F.col("p.x") + reach, "__d": F.col("p.y") + reach})
    outlined = cars.select("car_id", "x", "y", "height", geo.rectangle("x", "y", F.cos("ang"), F.sin("ang"), "len", "wid").alias("ring"))
    near = (F.col("x") >= F.col("__a")) & (F.col("x") <= F.col("__c")) & (F.col("y") >= F.col("__b")) & (F.col("y") <= F.col("__d"))
    pair = near_pairs(spread(outlined, "car_id"), p, "x", "y", ("__a", "__b", "__c", "__d"), 0.0, size).filter(near)
    ground = F.transform("ring", lambda v: geo.project(v.x, v.y, _pose(), F.col("p.axes"), cam))
    lower = {**_pose(), "alt": F.col("p.alt") - F.col("height")}
    roof = F.transform("ring", lambda v: geo.project(v.x, v.y, lower, F.col("p.axes"), cam))
    # both outlines are projected once per pair; what a generator makes is not copied into later uses
    bb = pair.select("frame_idx", "car_id", F.explode(F.array(geo.extent(F.concat(ground, roof)))).alias("b"))
    full = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    zero = F.lit(0.0)
    out = bb.withColumns({"x0": F.greatest(zero, "b.x0"), "y0": F.greatest(zero, "b.y0"), "x1": F.least(F.lit(float(cam.w)), "b.x1"),
                          "y1": F.least(F.lit(float(cam.h)), "b.y1"), "__full": full})
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ok = (w >= min_px) & (h >= min_px) & (F.col("__full") > 0) & (w * h / F.col("__full") >= min_visible)
    return out.filter(ok).select("frame_idx", "car_id", *[F.round(c, 1).alias(c) for c in ("x0", "y0", "x1", "y1")])


# ---- kerbs in frames -------------------------------------------------------

def observed_spans(samples: DataFrame, poses: DataFrame, cam: Camera, size: float = 30.0) -> DataFrame:
    """Stretches of each kerb inside each frame: ``(frame_idx, run_id, s0, s1)``.

    ``samples``: ``run_id, k, s, x, y, last, length_m`` every half metre.  A stretch ends at the first
    sample out of shot; the sample count of one frame and kerb is bounded by the footprint.
    """
    p = with_axes(poses).select("frame_idx", F.struct("x", "y", "alt", "yaw", "axes").alias("p"))
    reach = cam.reach(F.col("p.alt"))
    p = p.withColumns({"__a": F.col("p.x") - reach, "__b": F.col("p.y") - reach, "__c": F.col("p.x") + reach, "__d": F.col("p.y") + reach})
    pair = near_pairs(samples, p, "x", "y", ("__a", "__b", "__c", "__d"), 0.0, size)
    near = (F.col("x") >= F.col("__a")) & (F.col("x") <= F.col("__c")) & (F.col("y") >= F.col("__b")) & (F.col("y") <= F.col("__d"))
    pair = pair.filter(near)
    px = geo.project("x", "y", _pose(), F.col("p.axes"), cam)
    inside = (F.col("px.x") >= 0) & (F.col("px.x") < cam.w) & (F.col("px.y") >= 0) & (F.col("px.y") < cam.h)
    hits = pair.withColumn("px", px).filter(inside)
    w = Window.partitionBy("frame_idx", "run_id").orderBy("k")
    isle = hits.withColumn("isle", F.col("k") - F.row_number().over(w))
    spans = isle.groupBy("frame_idx", "run_id", "isle").agg(F.min("s").alias("s0"), F.max("k").alias("k1"), F.max("last").alias("last"), F.max("length_m").alias("length_m"))
    step = F.col("length_m") / F.col("last")
    end = F.when(F.col("k1") == F.col("last"), F.col("length_m")).otherwise((F.col("k1") + 1) * step)
    return spans.select("frame_idx", "run_id", "s0", end.alias("s1"))


def run_samples(runs: DataFrame, step: float = 0.5, line: str = "line") -> DataFrame:
    """Evenly spaced kerb points including both ends."""
    from .geometry import pieces, point_on, polyline_length

    # the pieces of a line are laid out once, before its samples are made
    base = spread(runs, "run_id").select("run_id", line, polyline_length(F.col(line)).alias("length_m"), F.explode(F.array(pieces(F.col(line)))).alias("pieces"))
    n = F.greatest(F.lit(2), F.floor(F.col("length_m") / step).cast("int") + 1)
    ks = base.withColumn("last", n - 1).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last"))))
    ks = ks.withColumn("s", F.col("length_m") * F.col("k") / F.col("last")).withColumn("q", point_on(F.col("pieces"), F.get(line, F.lit(0)), F.col("s")))
    return ks.select("run_id", "k", "s", F.col("q.x").alias("x"), F.col("q.y").alias("y"), "last", "length_m")


def run_extents(quads: DataFrame, segments: DataFrame, max_m: float = 6.0, min_len: float = 0.001) -> DataFrame:
    """``(det, frame_idx, run_id, s0, s1)``: the stretch of its nearest kerb each detection covers.

    ``quads``: ``event_id, frame_idx, quad``.  The middle of the quad decides the kerb; the corners, wherever
    they fall, decide the stretch.  Stretches below a millimetre are dropped.
    """
    from .spatial import assign_runs

    mid = quads.select("event_id", "frame_idx", "quad", geo.vertex_centroid(F.col("quad")).alias("m"))
    mid = mid.select("event_id", "frame_idx", "quad", F.col("m.x").alias("x"), F.col("m.y").alias("y"))
    own = assign_runs(mid.select("event_id", "x", "y"), segments, "event_id", "x", "y", max_m=max_m).select("event_id", "run_id")
    corners = mid.join(own, "event_id").select("event_id", "frame_idx", "run_id", F.posexplode("quad").alias("c", "q"))
    on = corners.join(segments, "run_id").withColumn("t", geo.segment_param("q.x", "q.y", "ax", "ay", "bx", "by"))
    d = geo.distance("q.x", "q.y", F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax")), F.col("ay") + F.col("t") * (F.col("by") - F.col("ay")))
    best = on.groupBy("event_id", "frame_idx", "run_id", "c").agg(F.min(F.struct(d.alias("d"), "seg", (F.col("s0") + F.col("t") * F.col("seg_len")).alias("s"))).alias("b"))
    ext = best.groupBy("event_id", "frame_idx", "run_id").agg(F.min("b.s").alias("s0"), F.max("b.s").alias("s1"))
    return ext.filter(F.col("s1") - F.col("s0") >= min_len)


