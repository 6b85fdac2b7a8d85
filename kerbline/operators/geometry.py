"""Geometry jobs on tables of rings and lines."""

from __future__ import annotations

import numpy as np

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo, text
from ..session import spread


def variants(df: DataFrame, rules: dict[str, Column], keep: list[str], name: str = "occupied") -> DataFrame:
    """One row per input row and rule; all rules read the same scan."""
    pairs = F.array(*[F.struct(F.lit(n).alias("variant"), c.alias(name)) for n, c in rules.items()])
    return df.select(*keep, F.explode(pairs).alias("v")).select(*keep, "v.variant", f"v.{name}")


def validate_labels(lines: DataFrame, line: str) -> DataFrame:
    """One row per problem of a label line; lines are judged once, and not before that to see whether they have any."""
    from .spatial import each

    return each(lines, "problem", text.label_problems(line))


def apply_corrections(bays: DataFrame, corrections: DataFrame) -> DataFrame:
    """Replacement outline, or turn about ``(cx, cy)`` plus shift; other bays stay as they are."""
    c = corrections.select("bay_id", F.struct("cx", "cy", "rot_deg", "dx", "dy", "ring").alias("__c"))
    zero = F.lit(0.0)
    moved = geo.rotate_ring(F.col("ring"), F.col("__c.cx"), F.col("__c.cy"), F.coalesce("__c.rot_deg", zero), F.coalesce("__c.dx", zero), F.coalesce("__c.dy", zero))
    ring = F.when(F.col("__c").isNull(), F.col("ring")).when(F.col("__c.ring").isNotNull(), F.col("__c.ring")).otherwise(moved)
    out = bays.join(c, "bay_id", "left").withColumn("ring", ring).drop("__c").withColumn("__m", geo.vertex_centroid(F.col("ring")))
    return out.withColumns({"cx": F.col("__m.x"), "cy": F.col("__m.y")}).drop("__m")


# ---- lines -------------------------------------------------------------------

def polyline_length(line: Column) -> Column:
    return geo.let(line, lambda v: geo.fold(F.sequence(F.lit(1), F.greatest(F.size(v) - 1, F.lit(1))), lambda i: F.when(
        i < F.size(v), geo.distance(F.get(v, i - 1).x, F.get(v, i - 1).y, F.get(v, i).x, F.get(v, i).y)).otherwise(0.0)))


def pieces(line: Column) -> Column:
    """Segments with their start arclength; zero-length ones dropped."""
    segs = geo.let(line, lambda v: F.filter(F.transform(
        F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))),
        lambda p, i: F.struct(p.x.alias("ax"), p.y.alias("ay"), F.get(v, i + 1).x.alias("bx"), F.get(v, i + 1).y.alias("by"),
                              geo.distance(p.x, p.y, F.get(v, i + 1).x, F.get(v, i + 1).y).alias("len"))), lambda e: e.len > 0))
    none = F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double,len:double,s0:double>>")
    start = F.struct(F.lit(0.0).alias("s"), none.alias("done"))
    return F.aggregate(segs, start, lambda a, e: F.struct(
        (a.s + e.len).alias("s"), F.concat(a.done, F.array(F.struct(e.ax, e.ay, e.bx, e.by, e.len, a.s.alias("s0")))).alias("done")), lambda a: a.done)


def _on(e: Column, s: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s - e.s0) / e.len))
    return geo.point(e.ax + t * (e.bx - e.ax), e.ay + t * (e.by - e.ay))


def point_at(line: Column, s: Column) -> Column:
    """Point ``s`` metres along a line, clamped to its ends."""
    return point_on(pieces(line), F.get(line, F.lit(0)), s)


def point_on(segs: Column, start: Column, s: Column) -> Column:
    """The same on the ``pieces`` of a line; ``start`` stands in for a line without any."""
    def reached(v):
        hit = F.coalesce(F.get(F.filter(v, lambda e: e.s0 + e.len >= s), F.lit(0)), F.get(v, F.size(v) - 1))
        return F.when(F.size(v) == 0, start).otherwise(geo.let(hit, lambda e: _on(e, s)))

    return geo.let(segs, reached)


def slice_by_arclength(line: Column, s0: Column, s1: Column) -> Column:
    """Vertices of the stretch between two arclengths, both ends cut."""
    hit = F.filter(pieces(line), lambda e: (e.s0 + e.len > s0) & (e.s0 < s1))
    first = F.get(hit, F.lit(0))
    tail = F.transform(hit, lambda e: _on(e, s1))
    return F.when(F.size(hit) > 0, F.concat(F.array(_on(first, s0)), tail)).otherwise(F.array_remove(F.array(geo.point(F.lit(0.0), F.lit(0.0))), geo.point(F.lit(0.0), F.lit(0.0))))


def vertices(lines: DataFrame, line: str, number: str, vertex: str) -> DataFrame:
    """A row per vertex in ``vertex``, numbered from 0; a plain ``posexplode`` would be tested for vertices in the scan, see ``spatial.each``."""
    kept = [c for c in lines.columns if c != line]
    return lines.select(*kept, F.posexplode_outer(line).alias(number, vertex)).filter(F.col(number).isNotNull())


def densify(lines: DataFrame, key: str, line: str, step: float) -> DataFrame:
    """A point every ``step`` metres: ``(key, k, s, x, y)``."""
    from .spatial import polyline_segments

    # every piece makes the samples behind its start up to its end, the first one its start as well
    first = F.when(F.col("s0") == 0, F.lit(0)).otherwise(F.floor(F.col("s0") / step) + 1).cast("bigint")
    last = F.floor((F.col("s0") + F.col("seg_len")) / step).cast("bigint")
    ks = F.when(last >= first, F.sequence(first, F.greatest(first, last)))
    t = F.least(F.lit(1.0), (F.col("s") - F.col("s0")) / F.col("seg_len"))
    return (polyline_segments(lines, key, line).withColumn("k", F.explode(ks)).withColumn("s", F.col("k") * F.lit(float(step)))
            .select(key, "k", "s", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y")))


def clip_lines(lines: DataFrame, key: str, line: str, lim: float) -> DataFrame:
    """Parts of lines inside ``|x|,|y| <= lim``: ``(key, part, seg, ax, ay, bx, by)``.

    Every segment is cut on its own; a part ends where the next cut piece does not continue it.
    """
    pts = F.col(line)
    raw = F.transform(F.slice(pts, F.lit(1), F.greatest(F.size(pts) - 1, F.lit(0))), lambda p, i: F.struct(
        i.alias("i"), p.x.alias("px"), p.y.alias("py"), (F.get(pts, i + 1).x - p.x).alias("dx"), (F.get(pts, i + 1).y - p.y).alias("dy")))

    def enter(d, lo):  # bounds d*t + lo <= lim
        t = (F.lit(lim) - lo) / F.nullif(d, F.lit(0.0))
        return F.when(d < 0, t).when((d == 0) & (lo > lim), F.lit(2.0)).otherwise(0.0), F.when(d > 0, t).otherwise(1.0)

    def cut_piece(e):
        los, his = zip(*[enter(d, lo) for d, lo in ((e.dx, e.px), (-e.dx, -e.px), (e.dy, e.py), (-e.dy, -e.py))])
        t0, t1 = F.greatest(F.lit(0.0), *los), F.least(F.lit(1.0), *his)
        return F.struct(e.i.alias("i"), (t0 < t1).alias("ok"), (e.px + t0 * e.dx).alias("ax"), (e.py + t0 * e.dy).alias("ay"),
                        (e.px + t1 * e.dx).alias("bx"), (e.py + t1 * e.dy).alias("by"))

    kept = F.filter(F.transform(raw, cut_piece), lambda e: e.ok)
    work = lines.select(key, kept.alias("__kept"))
    k = F.col("__kept")

    def breaks(i):
        a, b = F.get(k, i - 1), F.get(k, i)
        return (i > 0) & ((b.i != a.i + 1) | (geo.distance(a.bx, a.by, b.ax, b.ay) > 0.01))

    marked = F.transform(k, lambda e, i: F.struct(e.ax, e.ay, e.bx, e.by, F.coalesce(breaks(i), F.lit(False)).alias("brk")))
    work = work.withColumn("__m", marked)
    m = F.col("__m")
    zero = F.array(F.lit(0).cast("bigint"))
    parts = F.aggregate(m, zero, lambda acc, e: F.concat(acc, F.array(F.element_at(acc, -1) + e.brk.cast("bigint"))))
    zipped = F.arrays_zip(m.alias("e"), F.slice(parts, F.lit(2), F.size(m)).alias("part"))
    return work.select(key, F.posexplode(zipped).alias("seg", "z")).select(key, "z.part", "seg", "z.e.ax", "z.e.ay", "z.e.bx", "z.e.by")


def _per_ring(df: DataFrame, ring: str, fn) -> DataFrame:
    """Apply a numpy function to each ring; rings it empties are dropped."""
    def run(batches):
        for pdf in batches:
            out = [fn(np.array([(p["x"], p["y"]) for p in rg], dtype=float)) for rg in pdf[ring]]
            pdf = pdf.assign(**{ring: [[{"x": float(x), "y": float(y)} for x, y in o] for o in out]})
            yield pdf[[len(o) >= 3 for o in out]] if len(pdf) else pdf

    return spread(df).mapInPandas(run, df.schema)


def clip_polygons(df: DataFrame, ring: str, lim: float) -> DataFrame:
    """Rings cut to the square ``|x|,|y| <= lim``, one half plane after the other."""
    def clip(pts):
        for axis, sign in ((0, 1.0), (0, -1.0), (1, 1.0), (1, -1.0)):
            if not len(pts):
                break
            side = lim - sign * pts[:, axis]
            nxt, nside = np.roll(pts, -1, axis=0), np.roll(side, -1)
            rows = []
            for p, q, a, b in zip(pts, nxt, side, nside):
                if a >= 0:
                    rows.append(p)
                if (a >= 0) != (b >= 0):
                    rows.append(p + (q - p) * (a / (a - b)))
            pts = np.array(rows).reshape(-1, 2)
        return pts

    return _per_ring(df, ring, clip)


def simplify_rings(df: DataFrame, ring: str, tol: float) -> DataFrame:
    """Drop vertices closer than ``tol`` to the chord of their stretch (closed rings)."""
    def chord(pts, a, b):
        d = b - a
        n = np.hypot(*d)
        rel = pts - a
        return np.hypot(*rel.T) if n == 0 else np.abs(rel[:, 0] * d[1] - rel[:, 1] * d[0]) / n

    def thin(pts):
        if len(pts) > 1 and np.allclose(pts[0], pts[-1]):
            pts = pts[:-1]
        if len(pts) < 4:
            return pts
        far = int(np.argmax(np.hypot(*(pts - pts[0]).T)))
        loop = np.vstack([pts, pts[:1]])
        keep = {0, far, len(pts)}
        stack = [(0, far), (far, len(pts))]
        while stack:
            i, j = stack.pop()
            if j - i < 2:
                continue
            off = chord(loop[i + 1:j], loop[i], loop[j])
            k = int(np.argmax(off))
            if off[k] > tol:
                keep.add(i + 1 + k)
                stack += [(i, i + 1 + k), (i + 1 + k, j)]
        return loop[sorted(keep - {len(pts)})]

    return _per_ring(df, ring, thin)


