"""Planar geometry, map coordinates and camera maths as column expressions.

A ring or polyline is ``array<struct<x:double,y:double>>``; a closing vertex is allowed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .numeric import col
from .text import parking_kind

# Metres per degree and earth radius used for distances.
METRES_PER_DEGREE = 111320.0
EARTH_RADIUS_M = 6371000.0
# Pinned local origin (latitude, longitude).
ORIGIN = (42.6747105, 23.3298956)


def point(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def to_enu(lon, lat, origin=ORIGIN) -> tuple[Column, Column]:
    """Degrees to local metres about ``origin``."""
    scale = METRES_PER_DEGREE * math.cos(math.radians(origin[0]))
    return (col(lon) - F.lit(origin[1])) * scale, (col(lat) - F.lit(origin[0])) * METRES_PER_DEGREE


def to_lonlat(x, y, origin=ORIGIN) -> tuple[Column, Column]:
    """Local metres back to degrees."""
    scale = METRES_PER_DEGREE * math.cos(math.radians(origin[0]))
    return col(x) / scale + F.lit(origin[1]), col(y) / METRES_PER_DEGREE + F.lit(origin[0])


def distance(x0, y0, x1, y1) -> Column:
    dx, dy = col(x1) - col(x0), col(y1) - col(y0)
    return F.sqrt(dx * dx + dy * dy)


def haversine(lon0, lat0, lon1, lat1) -> Column:
    p0, p1 = F.radians(col(lat0)), F.radians(col(lat1))
    half_lat = F.sin((p1 - p0) / 2)
    half_lon = F.sin(F.radians(col(lon1) - col(lon0)) / 2)
    h = half_lat * half_lat + F.cos(p0) * F.cos(p1) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def mercator_px(lon, lat, zoom) -> tuple[Column, Column]:
    """Web-mercator pixel coordinates at a zoom level (256 px tiles)."""
    n = F.lit(256.0) * F.pow(F.lit(2.0), col(zoom) if not isinstance(zoom, int) else F.lit(zoom))
    s = F.sin(F.radians(col(lat)))
    u = (col(lon) + 180.0) / 360.0 * n
    v = (F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * n
    return u, v


# ---- rings ---------------------------------------------------------------

def let(value: Column, body) -> Column:
    """``body(v)`` for a value that is computed once; an expression repeated in a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _next(ring: Column, i: Column) -> Column:
    return F.get(ring, (i + 1) % F.size(ring))


def edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a ring, wrapping at the end."""
    return let(ring, lambda rg: F.transform(rg, lambda p, i: F.struct(p.alias("a"), _next(rg, i).alias("b"))))


def fold(items: Column, term, zero: float = 0.0) -> Column:
    """Sum of ``term(item)`` over an array."""
    return F.aggregate(items, F.lit(zero), lambda acc, e: acc + term(e))


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive for counter-clockwise rings."""
    return fold(edges(ring), lambda e: e.a.x * e.b.y - e.b.x * e.a.y) / 2


def open_ring(ring: Column) -> Column:
    """Drop the closing vertex when it repeats the first one."""
    def opened(rg):
        n = F.size(rg)
        closed = (n > 1) & (F.get(rg, F.lit(0)) == F.get(rg, n - 1))
        return F.when(closed, F.slice(rg, F.lit(1), n - 1)).otherwise(rg)

    return let(ring, opened)


def vertex_centroid(ring: Column) -> Column:
    def mean(rg):
        n = F.size(rg).cast("double")
        return point(fold(rg, lambda p: p.x) / n, fold(rg, lambda p: p.y) / n)

    return let(ring, mean)


def area_centroid(ring: Column, eps: float = 1e-9) -> Column:
    """Centre of mass; the vertex mean when the ring encloses nothing."""
    es, a = edges(ring), signed_area(ring)

    def cross(e):
        return e.a.x * e.b.y - e.b.x * e.a.y

    cx = fold(es, lambda e: (e.a.x + e.b.x) * cross(e)) / (6 * F.nullif(a, F.lit(0.0)))
    cy = fold(es, lambda e: (e.a.y + e.b.y) * cross(e)) / (6 * F.nullif(a, F.lit(0.0)))
    return F.when(F.abs(a) > eps, point(cx, cy)).otherwise(vertex_centroid(ring))


def circumradius(ring: Column) -> Column:
    """Largest vertex distance from the vertex centroid."""
    return let(ring, lambda rg: let(vertex_centroid(rg), lambda c: F.array_max(F.transform(rg, lambda p: distance(c.x, c.y, p.x, p.y)))))


def _longest_edge(ring: Column) -> Column:
    ranked = F.transform(
        edges(ring),
        lambda e: F.struct(distance(e.a.x, e.a.y, e.b.x, e.b.y).alias("len"), (e.b.x - e.a.x).alias("dx"), (e.b.y - e.a.y).alias("dy")),
    )
    # the first of equally long edges wins
    return let(ranked, lambda v: F.aggregate(
        F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))),
        F.get(v, F.lit(0)),
        lambda best, e: F.when(e.len > best.len + 1e-9, e).otherwise(best),
    ))


def long_axis_deg(ring: Column) -> Column:
    """Bearing of the longest edge, folded to [0, 180)."""
    return let(_longest_edge(ring), lambda e: F.pmod(F.degrees(F.atan2(e.dy, e.dx)), F.lit(180.0)))


def long_short(ring: Column) -> Column:
    """Longest and shortest edge length of an open ring."""
    lens = F.transform(edges(ring), lambda e: distance(e.a.x, e.a.y, e.b.x, e.b.y))
    return let(lens, lambda v: F.struct(F.array_max(v).alias("long_m"), F.array_min(v).alias("short_m")))


def bbox(ring: Column) -> Column:
    def box(rg):
        xs, ys = F.transform(rg, lambda p: p.x), F.transform(rg, lambda p: p.y)
        return F.struct(
            F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
            F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"),
        )

    return let(ring, box)


def point_in_ring(x, y, ring: Column) -> Column:
    """Even-odd test: count the edges a ray to the right of the point crosses."""
    px, py = col(x), col(y)

    def crosses(e):
        spans = (e.a.y > py) != (e.b.y > py)
        at = e.a.x + (py - e.a.y) / F.nullif(e.b.y - e.a.y, F.lit(0.0)) * (e.b.x - e.a.x)
        return F.coalesce(spans & (px < at), F.lit(False))

    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def point_in_geom(x, y, polygons: Column) -> Column:
    """``array<array<ring>>``: inside an outer ring and outside that polygon's holes."""
    def inside(poly):
        holes = F.slice(poly, F.lit(2), F.greatest(F.size(poly) - 1, F.lit(0)))
        return point_in_ring(x, y, F.get(poly, F.lit(0))) & ~F.exists(holes, lambda h: point_in_ring(x, y, h))

    return F.exists(polygons, inside)


def segment_distance(x, y, ax, ay, bx, by) -> Column:
    """Distance from a point to a segment; a zero-length segment counts as its end point."""
    t = segment_param(x, y, ax, ay, bx, by)
    return distance(x, y, col(ax) + t * (col(bx) - col(ax)), col(ay) + t * (col(by) - col(ay)))


def segment_param(x, y, ax, ay, bx, by) -> Column:
    """Clamped position 0..1 of the closest point on a segment."""
    dx, dy = col(bx) - col(ax), col(by) - col(ay)
    dd = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    raw = F.coalesce(((col(x) - col(ax)) * dx + (col(y) - col(ay)) * dy) / dd, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def ring_distance(x, y, ring: Column) -> Column:
    """Zero inside the ring, else the distance to its boundary."""
    def far(rg):
        near = F.array_min(F.transform(edges(rg), lambda e: segment_distance(x, y, e.a.x, e.a.y, e.b.x, e.b.y)))
        return F.when(point_in_ring(x, y, rg), F.lit(0.0)).otherwise(near)

    return let(ring, far)


def rectangle(cx, cy, ux, uy, length, width) -> Column:
    """Open ring of a rectangle whose long side points along the unit vector ``(ux, uy)``."""
    a, b = col(length) / 2, col(width) / 2
    cx, cy, ux, uy = col(cx), col(cy), col(ux), col(uy)
    # half the long side (lx, ly) and half the short side (wx, wy); no factor of -1, because a
    # literal -0.0 it could fold to breaks Spark's common-subexpression matching
    lx, ly, wx, wy = a * ux, a * uy, b * uy, b * ux
    parts = F.struct(*[e.cast("double").alias(n) for n, e in (("x", cx), ("y", cy), ("lx", lx), ("ly", ly), ("wx", wx), ("wy", wy))])
    return let(parts, lambda v: F.array(
        point(v.x + v.lx - v.wx, v.y + v.ly + v.wy), point(v.x + v.lx + v.wx, v.y + v.ly - v.wy),
        point(v.x - v.lx + v.wx, v.y - v.ly - v.wy), point(v.x - v.lx - v.wx, v.y - v.ly + v.wy)))


# Bay sizes in metres (along the long side, across it) and the angled turn.
BAY_SIZES = {"parallel": (5.4, 2.2), "perpendicular": (4.8, 2.4), "angled": (5.4, 2.2)}
BAY_TURN_DEG = {"parallel": 0.0, "perpendicular": 90.0, "angled": 45.0}


def bay_rectangle(cx, cy, street_deg, kind) -> Column:
    """Bay outline for a street bearing and a parking kind (unknown kinds lie parallel)."""
    k = parking_kind(kind)

    def pick(values):
        out = F.lit(values["parallel"])
        for name in ("perpendicular", "angled"):
            out = F.when(k == name, F.lit(values[name])).otherwise(out)
        return out

    th = F.radians(col(street_deg) + pick(BAY_TURN_DEG))
    return rectangle(
        cx, cy, F.cos(th), F.sin(th),
        pick({n: s[0] for n, s in BAY_SIZES.items()}), pick({n: s[1] for n, s in BAY_SIZES.items()}),
    )


def rotate_ring(ring: Column, cx, cy, deg, dx, dy) -> Column:
    """Rigid move: turn about ``(cx, cy)`` then shift."""
    c, s = F.cos(F.radians(col(deg))), F.sin(F.radians(col(deg)))
    cx, cy, dx, dy = col(cx), col(cy), col(dx), col(dy)
    move = F.struct(*[e.cast("double").alias(n) for n, e in (("cx", cx), ("cy", cy), ("dx", dx), ("dy", dy), ("c", c), ("s", s))])
    return let(move, lambda m: F.transform(
        ring,
        lambda p: point(m.cx + (p.x - m.cx) * m.c - (p.y - m.cy) * m.s + m.dx, m.cy + (p.x - m.cx) * m.s + (p.y - m.cy) * m.c + m.dy),
    ))


def rings_overlap(a: Column, b: Column) -> Column:
    """Convex rings share interior: no edge normal of either separates them."""
    def separated(src, dst):
        def gap(e):
            nx, ny = e.a.y - e.b.y, e.b.x - e.a.x
            along = F.struct(*[F.transform(rg, lambda p: p.x * nx + p.y * ny).alias(n) for n, rg in (("a", src), ("b", dst))])
            return let(along, lambda v: (F.array_max(v.a) <= F.array_min(v.b)) | (F.array_max(v.b) <= F.array_min(v.a)))

        return F.exists(edges(src), gap)

    return ~(separated(a, b) | separated(b, a))


def iou(a: dict, b: dict) -> Column:
    """Intersection over union of two boxes given as ``{x0,y0,x1,y1}`` columns."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    inter = w * h
    union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


# ---- camera --------------------------------------------------------------

@dataclass(frozen=True)
class Camera:
    """Pinhole camera: image size in pixels and horizontal field of view in radians."""

    w: int = 400
    h: int = 240
    fov_h: float = 0.7854

    @property
    def f(self) -> float:
        return self.w / (2.0 * math.tan(self.fov_h / 2.0))

    @property
    def fov_v(self) -> float:
        return 2.0 * math.atan(self.h / (2.0 * self.f))

    def footprint(self, alt) -> tuple[Column, Column]:
        """Ground width and height covered from ``alt`` metres."""
        return col(alt) * (self.w / self.f), col(alt) * (self.h / self.f)

    def gsd(self, alt) -> Column:
        """Metres on the ground per pixel."""
        return col(alt) / self.f

    def reach(self, alt) -> Column:
        """Radius that is certain to hold the footprint, with room for a small tilt."""
        half = math.hypot(math.tan(self.fov_h / 2.0), math.tan(self.fov_h / 2.0) * self.h / self.w)
        return col(alt) * (half + math.tan(TILT_ALLOWANCE))


# Tilt allowance in radians, smallest depth in metres.
TILT_ALLOWANCE = 0.06
MIN_DEPTH_M = 0.01


def camera_axes(yaw, roll=None, pitch=None, cam_pitch=None, cam_roll=None) -> Column:
    """Optical axis ``d``, image-right ``r`` and image-down ``b`` as structs of x,y,z.

    Roll is the body roll, pitch is what the gimbal leaves over, and ``cam_roll`` spins the
    picture about the optical axis.  A missing angle is a level camera looking straight down.

    Written out in the body frame (nose, left, up): rolling about the nose and then pitching about
    the left axis gives ``d = (-cr sp, sr, -cr cp)``, ``right = (-sr sp, -cr, -sr cp)`` and
    ``down = (-cp, 0, sp)``; the spin mixes the last two.
    """
    def ang(c, default=0.0):
        return F.lit(default) if c is None else F.coalesce(col(c).cast("double"), F.lit(default))

    def cos_sin(a):
        return F.cos(a), F.sin(a)

    cy, sy = cos_sin(col(yaw))
    cr, sr = cos_sin(ang(roll))
    cp, sp = cos_sin(ang(pitch) + ang(cam_pitch, math.pi / 2) - F.lit(math.pi / 2))
    ck, sk = cos_sin(ang(cam_roll))

    def world(nose, left, up):
        return F.struct((nose * cy - left * sy).alias("x"), (nose * sy + left * cy).alias("y"), up.alias("z"))

    d = world(-(cr * sp), sr, -(cr * cp))
    right = world(-(sr * sp * ck) - cp * sk, -(cr * ck), sp * sk - sr * cp * ck)
    down = world(sr * sp * sk - cp * ck, cr * sk, sp * ck + sr * cp * sk)
    return F.struct(d.alias("d"), right.alias("r"), down.alias("b"))


def project(x, y, pose: dict, axes: Column, cam: Camera) -> Column:
    """Ground point to pixel ``struct<x:u, y:v>``; depth never falls below a centimetre."""
    wx, wy, wz = col(x) - pose["x"], col(y) - pose["y"], -pose["alt"]

    def dot(v):
        return wx * v.x + wy * v.y + wz * v.z

    depth = F.greatest(dot(axes.d), F.lit(MIN_DEPTH_M))
    return point(F.lit(cam.w / 2.0) + F.lit(cam.f) * dot(axes.r) / depth,
                 F.lit(cam.h / 2.0) + F.lit(cam.f) * dot(axes.b) / depth)


def unproject(u, v, pose: dict, axes: Column, cam: Camera) -> Column:
    """Pixel to ground point; NULL when the ray does not come down."""
    su, sv = (col(u) - cam.w / 2.0) / cam.f, (col(v) - cam.h / 2.0) / cam.f
    ray = {k: axes.d[k] + su * axes.r[k] + sv * axes.b[k] for k in ("x", "y", "z")}
    t = pose["alt"] / F.nullif(-ray["z"], F.lit(0.0))
    return F.when(ray["z"] < -1e-9, point(pose["x"] + t * ray["x"], pose["y"] + t * ray["y"]))


def extent(ring_px: Column) -> Column:
    """Box and mean of an outline in one pass: ``struct<x0,y0,x1,y1,sx,sy,n>``."""
    inf = float("inf")
    start = F.struct(F.lit(inf).alias("x0"), F.lit(inf).alias("y0"), F.lit(-inf).alias("x1"), F.lit(-inf).alias("y1"),
                     F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"), F.lit(0.0).alias("n"))
    return F.aggregate(ring_px, start, lambda a, p: F.struct(
        F.least(a.x0, p.x).alias("x0"), F.least(a.y0, p.y).alias("y0"), F.greatest(a.x1, p.x).alias("x1"), F.greatest(a.y1, p.y).alias("y1"),
        (a.sx + p.x).alias("sx"), (a.sy + p.y).alias("sy"), (a.n + 1.0).alias("n")))


def fully_in_shot(e: Column, cam: Camera) -> Column:
    """Every corner inside the picture, for an ``extent``."""
    return (e.x0 >= 0) & (e.x1 < cam.w) & (e.y0 >= 0) & (e.y1 < cam.h)


def may_be_in_shot(box: Column, pose: dict, axes: Column, cam: Camera) -> Column:
    """False only if an outline with this ground box cannot be ``fully_in_shot``: a test of one point before all are projected.

    The middle of a box lies in the hull of whatever touches its four sides, so in front of the camera its pixel lies between theirs.
    """
    wx, wy, wz = (box.x0 + box.x1) / 2 - pose["x"], (box.y0 + box.y1) / 2 - pose["y"], -pose["alt"]

    def dot(v):
        return wx * v.x + wy * v.y + wz * v.z

    depth = dot(axes.d)
    # no corner is farther from the middle; one below the least depth can end up anywhere
    unsure = depth - distance(box.x0, box.y0, box.x1, box.y1) / 2 <= 2 * MIN_DEPTH_M
    # a pixel of room for rounding
    seen = [F.abs(dot(v)) * cam.f <= depth * (side / 2.0 + 1.0) for v, side in ((axes.r, cam.w), (axes.b, cam.h))]
    return unsure | (seen[0] & seen[1])


def overlaps_frame(e: Column, cam: Camera) -> Column:
    return (e.x1 >= 0) & (e.x0 < cam.w) & (e.y1 >= 0) & (e.y0 < cam.h)


def in_footprint(wx, wy, pose: dict, cam: Camera, margin: float = 1.0) -> Column:
    """Is a ground point inside the nadir rectangle below the drone, in its body frame?"""
    dx, dy = col(wx) - pose["x"], col(wy) - pose["y"]
    ahead = dx * F.cos(pose["yaw"]) + dy * F.sin(pose["yaw"])
    aside = -dx * F.sin(pose["yaw"]) + dy * F.cos(pose["yaw"])
    width, height = cam.footprint(pose["alt"])
    return (F.abs(ahead) <= height / 2 * margin) & (F.abs(aside) <= width / 2 * margin)
