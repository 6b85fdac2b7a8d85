"""Grid-bucketed spatial joins.

Every join is an equality on a grid cell, so Catalyst can hash, sort-merge or (when it has
measured one side to be small) broadcast it.  Only what a search found is merged with its points by a hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from ..functions.numeric import col
from ..session import cut
from .scan import top_per_key
from .search import closest


def cell(value, size: float) -> Column:
    return F.floor(col(value) / F.lit(float(size))).cast("bigint")


def at_cell(df: DataFrame, x, y, size: float, cx: str = "cx", cy: str = "cy") -> DataFrame:
    return df.withColumns({cx: cell(x, size), cy: cell(y, size)})


def each(df: DataFrame, name: str, values: Column) -> DataFrame:
    """A row per value in ``name``; rows without any are left out.

    They are left out afterwards: of a plain ``explode`` Spark makes a filter on the array, which it takes, with all that the array is
    made of, below earlier shuffles to the scan, where a table of few bytes is one task.
    """
    return df.withColumn(name, F.explode_outer(values)).filter(F.col(name).isNotNull())


def over_cells(df: DataFrame, x0, y0, x1, y1, size: float, margin: float = 0.0, cx: str = "cx", cy: str = "cy") -> DataFrame:
    """One row per cell that a box, grown by ``margin``, touches."""
    m = F.lit(float(margin))
    xs = F.sequence(cell(col(x0) - m, size), cell(col(x1) + m, size))
    ys = F.sequence(cell(col(y0) - m, size), cell(col(y1) + m, size))
    return each(each(df, cx, xs), cy, ys)


# Parts in which the points of one large cell are dealt, and the level of nesting from which a cell is large.
DEALT, LARGE = 8, 3


def with_level(df: DataFrame, box: tuple, size: float, name: str = "__level") -> DataFrame:
    """Add the level of a box: cells of side ``size * 2^level`` are as wide as the box, so it touches four of them at the most."""
    x0, y0, x1, y1 = (col(c) for c in box)
    extent = F.greatest(x1 - x0, y1 - y0) / F.lit(float(size))
    return df.withColumn(name, F.when(extent <= 1, F.lit(0)).otherwise(F.ceil(F.log2(extent)).cast("int")))


def levels_of(*leveled: DataFrame, name: str = "__level") -> list[int]:
    """Levels that occur: as many as box sizes have powers of two."""
    return sorted({r[0] for df in leveled for r in df.select(name).filter(F.col(name).isNotNull()).distinct().collect()})


def nested_cell(value, size: float, level) -> Column:
    return F.floor(col(value) / (F.lit(float(size)) * F.pow(F.lit(2.0), level))).cast("bigint")


def over_nested_cells(df: DataFrame, x0, y0, x1, y1, size: float, level) -> DataFrame:
    """One row per cell of ``level`` that a box touches, in ``__cx, __cy``."""
    xs, ys = (F.sequence(nested_cell(a, size, level), nested_cell(b, size, level)) for a, b in ((x0, x1), (y0, y1)))
    return each(each(df, "__cx", xs), "__cy", ys)


def points_in_boxes(points: DataFrame, items: DataFrame, px: str, py: str, box: tuple, size: float) -> DataFrame:
    """Points joined with every box that holds them, each pair once, whatever the sizes of the boxes.

    A box lies in cells of its own size: four rows at the most, ``DEALT`` times as many where a cell is large, as its points are then
    dealt in parts.  A point has one cell per level that occurs.
    """
    leveled = with_level(items, box, size)
    found = levels_of(leveled)
    at = points.withColumn("__level", F.explode(F.array(*[F.lit(n) for n in found]).cast("array<int>")))
    at = at.withColumns({"__cx": nested_cell(px, size, F.col("__level")), "__cy": nested_cell(py, size, F.col("__level")),
                         "__part": F.when(F.col("__level") >= LARGE, F.pmod(F.xxhash64(px, py), F.lit(DEALT)).cast("int")).otherwise(F.lit(0))})
    parts = F.explode(F.sequence(F.lit(0), F.when(F.col("__level") >= LARGE, F.lit(DEALT - 1)).otherwise(F.lit(0))))
    # dealt on both sides, as in near_pairs
    keys = ["__level", "__cx", "__cy", "__part"]
    lain = over_nested_cells(leveled, *box, size, F.col("__level")).withColumn("__part", parts).repartition(*keys)
    x0, y0, x1, y1 = (col(c) for c in box)
    inside = col(px).between(x0, x1) & col(py).between(y0, y1)
    return at.repartition(*keys).join(lain, keys).filter(inside).drop(*keys)


def near_pairs(points: DataFrame, items: DataFrame, px: str, py: str, box: tuple, reach: float, size: float | None = None,
               on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Points joined with every item whose box, grown by ``reach``, may hold them.

    A point sits in one cell only, so each candidate pair appears once.  ``on`` adds equality keys
    (a frame, a run).  The caller applies the exact predicate.
    """
    size = size or reach
    # both sides are dealt by the join's own keys: Spark measures the rows of all cells and not the few bytes they were made from, and
    # a broadcast that it planned by those bytes is given up, which it does only where no further shuffle is needed for that
    keys = [*(on or []), "__cx", "__cy"]
    left = at_cell(points, px, py, size, "__cx", "__cy").repartition(*keys)
    right = over_cells(items, *box, size, reach, "__cx", "__cy").repartition(*keys)
    out = left.join(right, keys, how)
    return out.drop("__cx", "__cy")


def nearest(points: DataFrame, items: DataFrame, point_id: str, item_id: str, px: str, py: str, ix: str, iy: str, limit: float | None = None, size: float | None = None) -> DataFrame:
    """``(point_id, item_id, dist)``: the closest item by position, ties to the least id.

    ``size`` is a distance at which most points have an item: those are settled by one look at the cells around them, and
    only the rest descend.

    Copies at one position are reduced to the least id, equal points to one, beforehand.  Without ``limit`` every point with a
    position finds an item, however far; with it, points without an item inside are left out.
    """
    sites = items.groupBy(F.col(ix).alias("lo0"), F.col(iy).alias("lo1")).agg(F.min(item_id).alias("__item")).withColumns({"hi0": F.col("lo0"), "hi1": F.col("lo1")})
    todo = points.select(F.col(point_id).alias("__pid"), F.col(px).cast("double").alias("p0"), F.col(py).cast("double").alias("p1"))
    spots = todo.select("p0", "p1").distinct().withColumn("point", F.struct("p0", "p1"))
    around = None
    if size is not None and (limit is None or size < limit):
        close = near_pairs(spots.drop("point"), sites.drop("hi0", "hi1"), "p0", "p1", ("lo0", "lo1", "lo0", "lo1"), size, size)
        close = close.withColumn("dist", geo.distance("p0", "p1", "lo0", "lo1")).filter(F.col("dist") <= size)
        looked = cut(spots.join(close.groupBy("p0", "p1").agg(F.min(F.struct("dist", "__item")).alias("b")), ["p0", "p1"], "left"))
        around = looked.filter("b is not null").select("point", "b.__item", "b.dist")
        spots = looked.filter("b is null").drop("b")
    found = closest(spots, sites, 2, lambda: geo.distance("p0", "p1", "lo0", "lo1"), "__item", limit=limit).select("point", "__item", "dist")
    if around is not None:
        found = found.unionByName(around)
    # a row per position: merged, as the files that settled points are read from are fewer bytes than the rows
    found = found.select(F.col("point.p0").alias("q0"), F.col("point.p1").alias("q1"), "__item", "dist").hint("merge")
    return (todo.join(found, (F.col("p0") == F.col("q0")) & (F.col("p1") == F.col("q1")))
            .select(F.col("__pid").alias(point_id), F.col("__item").alias(item_id), "dist"))


def polyline_segments(lines: DataFrame, key: str, line: str) -> DataFrame:
    """``(key, seg, ax, ay, bx, by, s0, seg_len)`` of an array polyline; zero-length pieces dropped."""
    pts = F.col(line)
    n = F.size(pts)
    pairs = F.transform(
        F.slice(pts, F.lit(1), F.greatest(n - 1, F.lit(0))),
        lambda p, i: F.struct(p.x.alias("ax"), p.y.alias("ay"), F.get(pts, i + 1).x.alias("bx"), F.get(pts, i + 1).y.alias("by")),
    )
    with_len = F.transform(pairs, lambda e: F.struct(e.ax.alias("ax"), e.ay.alias("ay"), e.bx.alias("bx"), e.by.alias("by"),
                                                     geo.distance(e.ax, e.ay, e.bx, e.by).alias("seg_len")))
    # one running sum; it is zipped to the pieces, as an expression inside a lambda would be computed for every piece
    before = F.aggregate(with_len, F.array(F.lit(0.0)), lambda acc, e: F.concat(acc, F.array(F.element_at(acc, -1) + e.seg_len)))
    placed = lines.select(key, F.posexplode_outer(F.arrays_zip(with_len.alias("e"), before.alias("s0"))).alias("seg", "z")).filter("z.e is not null")
    return placed.select(key, "seg", "z.e.ax", "z.e.ay", "z.e.bx", "z.e.by", "z.s0", "z.e.seg_len").filter("seg_len > 0")


def locate(points: DataFrame, segments: DataFrame, point_id: str, px: str, py: str, key: str, max_m: float,
           same_key: bool = False, size: float | None = None) -> DataFrame:
    """Closest position on each polyline within ``max_m``: ``(point_id, key, s, lateral, dist)``.

    The gate is the true distance.  ``lateral`` is signed, positive to the left of travel.
    ``same_key`` compares a point only with its own polyline.
    """
    segs = segments.withColumns({
        "__x0": F.least("ax", "bx"), "__x1": F.greatest("ax", "bx"),
        "__y0": F.least("ay", "by"), "__y1": F.greatest("ay", "by"),
    })
    size = size or max(4 * max_m, 1.0)
    cand = near_pairs(points.select(point_id, px, py, *([key] if same_key else [])), segs, px, py,
                      ("__x0", "__y0", "__x1", "__y1"), max_m, size, on=[key] if same_key else None)
    t = geo.segment_param(px, py, "ax", "ay", "bx", "by")
    cand = cand.withColumn("__t", t)
    cand = cand.withColumns({
        "__d": geo.distance(px, py, F.col("ax") + F.col("__t") * (F.col("bx") - F.col("ax")),
                            F.col("ay") + F.col("__t") * (F.col("by") - F.col("ay"))),
        "__lat": ((F.col(px) - F.col("ax")) * (F.col("ay") - F.col("by"))
                  + (F.col(py) - F.col("ay")) * (F.col("bx") - F.col("ax"))) / F.col("seg_len"),
    }).filter(F.col("__d") <= max_m)
    best = cand.groupBy(point_id, key).agg(F.min(F.struct(
        F.col("__d").alias("d"), F.col("seg"), (F.col("s0") + F.col("__t") * F.col("seg_len")).alias("s"),
        F.col("__lat").alias("lat"))).alias("b"))
    return best.select(point_id, key, F.col("b.s").alias("s"), F.col("b.lat").alias("lateral"), F.col("b.d").alias("dist"))


def assign_runs(points: DataFrame, segments: DataFrame, point_id: str, px: str, py: str, key: str = "run_id", max_m: float = 6.0) -> DataFrame:
    """Each point goes to its nearest run only (ties to the least key)."""
    every = locate(points, segments, point_id, px, py, key, max_m)
    best = every.groupBy(point_id).agg(F.min(F.struct("dist", F.col(key), "s", "lateral")).alias("b"))
    return best.select(point_id, f"b.{key}", "b.s", "b.lateral", "b.dist")


def points_in_areas(points: DataFrame, areas: DataFrame, px: str, py: str, ring: str = "ring", size: float = 50.0) -> DataFrame:
    """Inner join of points with the polygons that hold them."""
    # boxes are laid out once, and behind a generator: what is asked of them is not asked of the outlines in the scan
    boxed = areas.withColumn("__b", F.explode(F.array(geo.bbox(F.col(ring)))))
    corners = tuple(f"__{k}" for k in ("x0", "y0", "x1", "y1"))
    boxed = cut(boxed.withColumns({c: F.col(f"__b.{c[2:]}") for c in corners}).drop("__b"))
    cand = points_in_boxes(points, boxed, px, py, corners, size)
    return cand.filter(geo.point_in_ring(px, py, F.col(ring))).drop(*corners)


def _once(df: DataFrame, side: str, *corners: Column) -> DataFrame:
    """Add corners as ``__<side>x0`` and so on; what a generator makes is not copied into every later use of it."""
    names = [f"__{side}{c}" for c in ("x0", "y0", "x1", "y1")]
    box = F.explode(F.array(F.struct(*[e.alias(n) for e, n in zip(corners, names)])))
    return df.withColumn("__box", box).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"__box.{n}") for n in names])


def box_pairs(left: DataFrame, right: DataFrame, lbox: tuple, rbox: tuple, size: float, on: list[str] | None = None,
              reach: float = 0.0) -> DataFrame:
    """Pairs of rows whose boxes, the left grown by ``reach``, touch; each pair once.

    A box is laid over cells of its own size and of the larger sizes that occur, four rows for each; two boxes meet in cells
    of the larger one's size, and are kept only in the first cell they share.
    """
    m = F.lit(float(reach))
    lm = _once(left, "l", col(lbox[0]) - m, col(lbox[1]) - m, col(lbox[2]) + m, col(lbox[3]) + m)
    rm = _once(right, "r", *[col(c) for c in rbox])
    lm = with_level(lm, ("__lx0", "__ly0", "__lx1", "__ly1"), size, "__ll")
    rm = with_level(rm, ("__rx0", "__ry0", "__rx1", "__ry1"), size, "__rl")
    found = F.array(*[F.lit(n) for n in sorted({*levels_of(lm, name="__ll"), *levels_of(rm, name="__rl")})]).cast("array<int>")
    a = over_nested_cells(lm.withColumn("__level", F.explode(F.filter(found, lambda n: n >= F.col("__ll")))), "__lx0", "__ly0", "__lx1", "__ly1", size, F.col("__level"))
    b = over_nested_cells(rm.withColumn("__level", F.explode(F.filter(found, lambda n: n >= F.col("__rl")))), "__rx0", "__ry0", "__rx1", "__ry1", size, F.col("__level"))
    keys = [*(on or []), "__level", "__cx", "__cy"]
    out = a.repartition(*keys).join(b.repartition(*keys), keys).filter(
        (F.col("__level") == F.greatest("__ll", "__rl"))
        & (F.col("__lx0") <= F.col("__rx1")) & (F.col("__rx0") <= F.col("__lx1")) & (F.col("__ly0") <= F.col("__ry1")) & (F.col("__ry0") <= F.col("__ly1"))
        & (F.col("__cx") == nested_cell(F.greatest("__lx0", "__rx0"), size, F.col("__level"))) & (F.col("__cy") == nested_cell(F.greatest("__ly0", "__ry0"), size, F.col("__level"))))
    return out.drop(*[f"__{s}{c}" for s in "lr" for c in ("x0", "y0", "x1", "y1", "l")], "__level", "__cx", "__cy")


def k_nearest(points: DataFrame, items: DataFrame, point_id: str, item_id: str, k: int, on: str) -> DataFrame:
    """The ``k`` closest items sharing the ``on`` key: ``(point_id, item_id, ix, iy, dist)``; of a pile its ``k`` least ids are enough."""
    few = top_per_key(items.select(item_id, on, "x", "y"), [on, "x", "y"], [F.col(item_id)], k, F.col(item_id)).drop("rank")
    boxes = few.select(F.col(item_id), F.col(on), *[F.col(c).alias(n) for c, n in (("x", "lo0"), ("x", "hi0"), ("y", "lo1"), ("y", "hi1"))])
    pts = points.select(F.col(point_id).alias("point"), on, F.col("x").alias("p0"), F.col("y").alias("p1"))
    found = closest(pts, boxes, 2, lambda: geo.distance("p0", "p1", "lo0", "lo1"), item_id, k=k, keys=[on])
    return found.select(F.col("point").alias(point_id), item_id, F.col("lo0").alias("ix"), F.col("lo1").alias("iy"), "dist")


# Fixed value: a bay farther than this from every centre line is not on one.
MAX_SNAP_M = 40.0


def nearest_road(bays: DataFrame, roads: DataFrame, snap_m: float = MAX_SNAP_M) -> DataFrame:
    """``(bay_id, dist, bearing_deg, ox, oy, name, named)``: own street within ``snap_m``, else any road.

    ``roads`` are segments ``name, ax, ay, bx, by``; ``(ox, oy)`` points from the road to the bay.
    Bays beyond ``snap_m`` of every road are absent.
    """
    from ..functions.text import norm_street

    segs = roads.filter(geo.distance("ax", "ay", "bx", "by") > 0).select(
        F.col("name"), norm_street("name").alias("__rn"), "ax", "ay", "bx", "by",
        F.least("ax", "bx").alias("__x0"), F.least("ay", "by").alias("__y0"), F.greatest("ax", "bx").alias("__x1"), F.greatest("ay", "by").alias("__y1"))
    pts = bays.select("bay_id", "x", "y", norm_street("street").alias("__sn"))
    cand = near_pairs(pts, segs, "x", "y", ("__x0", "__y0", "__x1", "__y1"), snap_m, snap_m)
    cand = cand.withColumn("__t", geo.segment_param("x", "y", "ax", "ay", "bx", "by")).withColumns({
        "ox": F.col("x") - F.col("ax") - F.col("__t") * (F.col("bx") - F.col("ax")),
        "oy": F.col("y") - F.col("ay") - F.col("__t") * (F.col("by") - F.col("ay"))})
    cand = cand.withColumn("d", F.sqrt(F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy"))).filter(F.col("d") <= snap_m)
    own = (F.col("__rn") != "") & (F.col("__sn") != "") & (F.col("__rn").contains(F.col("__sn")) | F.col("__sn").contains(F.col("__rn")))
    hit = F.struct("d", F.degrees(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))).alias("bearing"), "ox", "oy", "name")
    best = cand.groupBy("bay_id").agg(F.min(hit).alias("any"), F.min(F.when(own, hit)).alias("own"))
    b = F.coalesce("own", "any")
    return best.select("bay_id", b["d"].alias("dist"), b["bearing"].alias("bearing_deg"), b["ox"].alias("ox"), b["oy"].alias("oy"),
                       b["name"].alias("name"), F.col("own").isNotNull().alias("named"))


def closest_road(bays: DataFrame, roads: DataFrame) -> DataFrame:
    """``(bay_id, dist, bearing_deg, name)``: the closest road of all, however far."""
    segs = roads.filter(geo.distance("ax", "ay", "bx", "by") > 0).select(
        F.degrees(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))).alias("bearing_deg"), "name", "ax", "ay", "bx", "by",
        F.least("ax", "bx").alias("lo0"), F.least("ay", "by").alias("lo1"), F.greatest("ax", "bx").alias("hi0"), F.greatest("ay", "by").alias("hi1")).distinct()
    pts = bays.select(F.col("bay_id").alias("point"), F.col("x").alias("p0"), F.col("y").alias("p1"))
    found = closest(pts, segs, 2, lambda: geo.segment_distance("p0", "p1", "ax", "ay", "bx", "by"), "bearing_deg")
    return found.select(F.col("point").alias("bay_id"), "dist", "bearing_deg", "name")


def street_bearing(bays: DataFrame, roads: DataFrame, snap_m: float = MAX_SNAP_M) -> DataFrame:
    """``(bay_id, bearing_deg)`` in [0, 180): road direction, else the axis of the six nearest bays of the
    street, else the direction to the nearest bay of all."""
    # what several parts read is written, as each would search again
    on_road = cut(nearest_road(bays, roads, snap_m).select("bay_id", "bearing_deg"))
    rest = cut(bays.select("bay_id", "street", "x", "y").join(on_road, "bay_id", "left_anti"))
    out = on_road
    if not rest.isEmpty():
        near = k_nearest(rest, bays.select(F.col("bay_id").alias("other"), "street", "x", "y"), "bay_id", "other", 6, "street")
        fit = near.groupBy("bay_id").agg(F.count(F.lit(1)).alias("n"), F.var_pop("ix").alias("vx"), F.var_pop("iy").alias("vy"), F.covar_pop("ix", "iy").alias("cxy"))
        axis = cut(fit.filter("n >= 3").select("bay_id", F.degrees(F.atan2(2 * F.col("cxy"), F.col("vx") - F.col("vy")) / 2).alias("bearing_deg")))
        lone = cut(rest.join(axis, "bay_id", "left_anti"))
        twin = k_nearest(lone.withColumn("__k", F.lit(1)), bays.select(F.col("bay_id").alias("other"), "x", "y").withColumn("__k", F.lit(1)), "bay_id", "other", 2, "__k")
        toward = (twin.filter(F.col("bay_id") != F.col("other")).join(lone.select("bay_id", "x", "y"), "bay_id").groupBy("bay_id")
                  .agg(F.min(F.struct("dist", (F.col("ix") - F.col("x")).alias("dx"), (F.col("iy") - F.col("y")).alias("dy"))).alias("b")))
        out = out.unionByName(axis).unionByName(toward.select("bay_id", F.degrees(F.atan2(F.col("b.dy"), F.col("b.dx"))).alias("bearing_deg")))
    return out.select("bay_id", F.pmod("bearing_deg", F.lit(180.0)).alias("bearing_deg"))


def row_side(bays: DataFrame, roads: DataFrame) -> DataFrame:
    """``(bay_id, label)``: street plus the compass side of its centre line the bay lies on."""
    road = nearest_road(bays, roads)
    ns = F.when(F.col("oy") > 0, "N").otherwise("S")
    ew = F.when(F.col("ox") > 0, "E").otherwise("W")
    side = F.when(F.abs("oy") >= F.abs("ox"), ns).otherwise(ew)
    street = F.coalesce("street", F.lit("?"))
    plain = F.col("dist").isNull() | (F.col("dist") < 0.5)
    return bays.select("bay_id", "street").join(road, "bay_id", "left").select(
        "bay_id", F.when(plain, street).otherwise(F.concat(street, F.lit(" - "), side)).alias("label"))


def overlapping(bays: DataFrame, size: float = 12.0) -> DataFrame:
    """``(a, b)`` pairs of bays whose outlines share ground, ``a`` before ``b`` by ``ord``."""
    boxed = bays.select("bay_id", "ord", "ring", geo.bbox(F.col("ring")).alias("bb"))
    a = boxed.select(F.col("bay_id").alias("a"), F.col("ord").alias("oa"), F.col("ring").alias("ra"), F.col("bb").alias("ba"))
    b = boxed.select(F.col("bay_id").alias("b"), F.col("ord").alias("ob"), F.col("ring").alias("rb"), F.col("bb").alias("bb"))
    corner = ("x0", "y0", "x1", "y1")
    p = box_pairs(a, b, tuple(f"ba.{c}" for c in corner), tuple(f"bb.{c}" for c in corner), size)
    return p.filter((F.col("oa") < F.col("ob")) & geo.rings_overlap(F.col("ra"), F.col("rb"))).select("a", "b")


def off_route(points: DataFrame, segments: DataFrame, point_id: str, px: str, py: str) -> DataFrame:
    """``(point_id, dist)`` to the closest segment, however far."""
    segs = segments.select("ax", "ay", "bx", "by").distinct().select("*", F.least("ax", "bx").alias("lo0"), F.least("ay", "by").alias("lo1"), F.greatest("ax", "bx").alias("hi0"), F.greatest("ay", "by").alias("hi1"))
    pts = points.select(F.col(point_id).alias("point"), F.col(px).alias("p0"), F.col(py).alias("p1"))
    return closest(pts, segs, 2, lambda: geo.segment_distance("p0", "p1", "ax", "ay", "bx", "by"), "ax").select(F.col("point").alias(point_id), "dist")


def nearest_geo(points: DataFrame, items: DataFrame, point_id: str, item_id: str) -> DataFrame:
    """Closest item by great-circle distance for tables with ``lon`` and ``lat``.

    Searched on the sphere itself: chords between unit vectors grow with the distance along it.
    """
    def vector(df: DataFrame, names: tuple[str, str, str]) -> DataFrame:
        lon, lat = F.radians("lon"), F.radians("lat")
        return df.withColumns(dict(zip(names, (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)))))

    sites = vector(items.groupBy("lon", "lat").agg(F.min(item_id).alias(item_id)), ("lo0", "lo1", "lo2"))
    sites = sites.select(item_id, F.col("lon").alias("ilon"), F.col("lat").alias("ilat"), *[F.col(f"lo{d}") for d in range(3)], *[F.col(f"lo{d}").alias(f"hi{d}") for d in range(3)])
    pts = vector(points.select(F.col(point_id).alias("point"), "lon", "lat"), ("p0", "p1", "p2")).withColumnsRenamed({"lon": "plon", "lat": "plat"})
    found = closest(pts, sites, 3, lambda: geo.haversine("plon", "plat", "ilon", "ilat"), item_id)
    return found.select(F.col("point").alias(point_id), item_id, "dist")


def airspace_conflicts(points: DataFrame, zones: DataFrame, px: str, py: str, alt: float | None = None, size: float = 250.0) -> DataFrame:
    """Points inside zones, with the zone's id and restriction; ``alt`` keeps zones that reach that height."""
    if alt is not None:
        zones = zones.filter((F.coalesce("lower_m", F.lit(0.0)) <= alt) & (F.col("upper_m").isNull() | (F.col("upper_m") >= alt)))
    return points_in_areas(points, zones.select("identifier", "restriction", "ring"), px, py, size=size).drop("ring")


# Fixed values, metres: flight level, clearance above a structure, distance from the route.
FLIGHT_LEVEL_M, CLEARANCE_ABOVE_M, ROUTE_MARGIN_M = 30.0, 5.0, 10.0


def route_hazards(structures: DataFrame, route: DataFrame, level_m: float = FLIGHT_LEVEL_M, above_m: float = CLEARANCE_ABOVE_M, margin_m: float = ROUTE_MARGIN_M) -> DataFrame:
    """``(osm_id, height_m, min_route_dist_m)`` of structures that reach into the flight level near the route.

    The distance is zero when a route end lies inside or a piece crosses the outline.
    """
    tall = structures.filter(F.col("top") + above_m > level_m).select("osm_id", "top", "ring", geo.bbox(F.col("ring")).alias("bb"))
    legs = route.select("ax", "ay", "bx", "by", F.least("ax", "bx").alias("lx0"), F.least("ay", "by").alias("ly0"), F.greatest("ax", "bx").alias("lx1"), F.greatest("ay", "by").alias("ly1"))
    p = box_pairs(tall, legs, ("bb.x0", "bb.y0", "bb.x1", "bb.y1"), ("lx0", "ly0", "lx1", "ly1"), 50.0, reach=margin_m)

    def side(ax, ay, bx, by, px, py):
        return (bx - ax) * (py - ay) - (by - ay) * (px - ax)

    def to_edge(e):
        a, b = (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))
        cross = (side(*a, *b, e.a.x, e.a.y) * side(*a, *b, e.b.x, e.b.y) < 0) & (side(e.a.x, e.a.y, e.b.x, e.b.y, *a) * side(e.a.x, e.a.y, e.b.x, e.b.y, *b) < 0)
        ends = F.least(geo.segment_distance(*a, e.a.x, e.a.y, e.b.x, e.b.y), geo.segment_distance(*b, e.a.x, e.a.y, e.b.x, e.b.y),
                       geo.segment_distance(e.a.x, e.a.y, *a, *b), geo.segment_distance(e.b.x, e.b.y, *a, *b))
        return F.when(cross, F.lit(0.0)).otherwise(ends)

    inside = geo.point_in_ring("ax", "ay", F.col("ring")) | geo.point_in_ring("bx", "by", F.col("ring"))
    d = F.when(inside, F.lit(0.0)).otherwise(F.array_min(F.transform(geo.edges(F.col("ring")), to_edge)))
    best = p.withColumn("d", d).groupBy("osm_id").agg(F.max("top").alias("top"), F.min("d").alias("d")).filter(F.col("d") <= margin_m)
    return best.select("osm_id", F.round("top", 1).alias("height_m"), F.round("d", 1).alias("min_route_dist_m"))


def min_separation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Least distance between two point sets (``min_m``, NULL when one is empty)."""
    found = nearest(a.select("x", "y").distinct().withColumn("p", F.struct("x", "y")), b.withColumn("i", F.struct("x", "y")), "p", "i", "x", "y", "x", "y")
    return found.agg(F.min("dist").alias("min_m"))


def buffer_exclude(train: DataFrame, val: DataFrame, key: str, metres: float) -> DataFrame:
    """Rows of ``train`` that keep at least ``metres`` from every row of ``val``."""
    pv = val.select(F.col("x").alias("vx"), F.col("y").alias("vy")).distinct()
    near = near_pairs(train.select(key, "x", "y"), pv, "x", "y", ("vx", "vy", "vx", "vy"), metres, metres)
    hit = near.filter(geo.distance("x", "y", "vx", "vy") < metres).select(key).distinct()
    return train.join(hit, key, "left_anti")
