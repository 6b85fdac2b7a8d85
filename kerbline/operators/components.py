"""Connected components and single-link clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .spatial import cell

# Direct point comparisons allowed per undecided cell pair before it is split further.
PAIR_BUDGET = 1024
# Neighbours from which a node is a hub, and the parts its neighbours are dealt in.
HUB, HUB_PARTS = 512, 128


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "id", a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` with the least node id of the component as label.

    Edges are rewired to stars: first every greater neighbour of a node to the least of its neighbourhood, then
    every lesser one.  The least node of a neighbourhood is a map-side combined aggregate, so a hub is one small row; its neighbours
    meet that row in parts, so no task's rows follow the size of a component.  Edges inside a finished star stay as they are.
    A row per node is merged in, never sent through the driver: every round would send one again.
    Rounds run until nothing changes; each is cut in shared storage.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    star = cut(pairs)
    before = None
    while True:
        state = star.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")))
        upward = cut(_meet_least(star.select(F.col("v").alias("u"), F.col("u").alias("far")), least).distinct())
        low = upward.groupBy("u").agg(F.min("v").alias("m"))
        down = upward.join(low.hint("merge"), "u")
        star = cut(down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    labels = star.groupBy("u").agg(F.min("v").alias("label"))
    return (nodes.select(F.col(node).alias("id")).join(labels, F.col("id") == F.col("u"), "left")
            .select(F.col("id").alias(node), F.coalesce("label", "id").alias("label")))


def _meet_least(outer: DataFrame, least: DataFrame) -> DataFrame:
    """``(far, m)`` as ``(u, v)``: what lies around each node with the least of its neighbourhood; hubs apart from the rest.

    The list of hubs is shorter than the edges by a factor of ``HUB``; Spark broadcasts it where it measures it as small.
    """
    hubs = least.filter(F.col("n") >= HUB).select(F.col("u").alias("hub"), "m")
    plain = outer.join(hubs.select("hub"), F.col("u") == F.col("hub"), "left_anti").join(least.filter(F.col("n") < HUB).select("u", "m").hint("merge"), "u").select(F.col("far").alias("u"), F.col("m").alias("v"))
    parts = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(HUB_PARTS - 1))))
    dealt = outer.withColumn("deal", F.pmod(F.xxhash64("far"), F.lit(HUB_PARTS)).cast("int"))
    around = dealt.join(parts, (F.col("u") == F.col("hub")) & (F.col("deal") == F.col("part"))).select(F.col("far").alias("u"), F.col("m").alias("v"))
    return plain.unionByName(around)


def _boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
                                     F.count(F.lit(1)).alias("n"))


def _gap(axis: str, far: bool):
    a0, a1, b0, b1 = (F.col(f"{s}.{axis}{i}") for s in "ab" for i in "01")
    if far:
        return F.greatest(F.abs(b1 - a0), F.abs(a1 - b0))
    return F.greatest(b0 - a1, a0 - b1, F.lit(0.0))


def _reach(far: bool):
    dx, dy = _gap("x", far), _gap("y", far)
    return F.sqrt(dx * dx + dy * dy)


def linked_cells(points: DataFrame, r: float) -> tuple[DataFrame, DataFrame]:
    """Occupied cells of side just under ``r/sqrt(2)`` and the cell pairs with points within ``r``.

    Points sharing a cell are within ``r`` by construction, so a pile of points is one node.
    Neighbouring cells are decided by their boxes when those settle it; small undecided pairs by
    their points; large ones are split into quarter-side cells and tried again.
    """
    side = r * 0.7071
    pts = (points.select("grp", "x", "y").distinct()
           .withColumns({"gx": cell("x", side), "gy": cell("y", side)}))
    pts = cut(pts)
    cells = _boxes(pts, ["grp", "gx", "gy"])
    cells = cut(cells)
    # half of the neighbourhood, so each pair is looked at once
    offsets = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    moved = cells.withColumn("o", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in offsets])))
    left = moved.withColumns({"hx": F.col("gx") + F.col("o.x"), "hy": F.col("gy") + F.col("o.y")})
    pair = left.alias("a").join(cells.alias("b"), (F.col("a.grp") == F.col("b.grp")) & (F.col("a.hx") == F.col("b.gx")) & (F.col("a.hy") == F.col("b.gy")))
    ids = [F.col("a.grp").alias("g"), F.col("a.gx").alias("ax"), F.col("a.gy").alias("ay"), F.col("b.gx").alias("bx"), F.col("b.gy").alias("by")]
    key = ["g", "ax", "ay", "bx", "by"]
    near = cut(pair.select(*ids, (F.col("a.n") * F.col("b.n")).alias("work"), _reach(False).alias("lo"), _reach(True).alias("hi")).filter(F.col("lo") <= r))
    linked = near.filter(F.col("hi") <= r).select(*key)
    open_ = near.filter(F.col("hi") > r).select(*key, "work")

    def direct(pairs: DataFrame, subs: list[str], located: DataFrame) -> DataFrame:
        """Exact test of the points of small pairs."""
        la = located.select(*[F.col(c).alias(f"p_{c}") for c in ("grp", "gx", "gy", *subs)], F.col("x").alias("px"), F.col("y").alias("py"))
        lb = located.select(*[F.col(c).alias(f"q_{c}") for c in ("grp", "gx", "gy", *subs)], F.col("x").alias("qx"), F.col("y").alias("qy"))
        on_a = [F.col("g") == F.col("p_grp"), F.col("ax") == F.col("p_gx"), F.col("ay") == F.col("p_gy"), *[F.col(f"a_{s}") == F.col(f"p_{s}") for s in subs]]
        on_b = [F.col("g") == F.col("q_grp"), F.col("bx") == F.col("q_gx"), F.col("by") == F.col("q_gy"), *[F.col(f"b_{s}") == F.col(f"q_{s}") for s in subs]]
        d = F.sqrt((F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2)
        return pairs.join(la, on_a).join(lb, on_b).filter(d <= r).select(*key).distinct()

    linked = linked.unionByName(direct(open_.filter(F.col("work") <= PAIR_BUDGET), [], pts))
    todo = cut(open_.filter(F.col("work") > PAIR_BUDGET).select(*key))
    fine = side
    parent: list[str] = []
    level = 0
    while not todo.isEmpty():
        fine /= 4
        level += 1
        sub = [f"sx{level}", f"sy{level}"]
        pts = pts.withColumns({sub[0]: cell("x", fine), sub[1]: cell("y", fine)})
        boxes = _boxes(pts, ["grp", "gx", "gy", *parent, *sub])
        aa = [F.col("t.g") == F.col("a.grp"), F.col("t.ax") == F.col("a.gx"), F.col("t.ay") == F.col("a.gy"), *[F.col(f"t.a_{s}") == F.col(f"a.{s}") for s in parent]]
        bb = [F.col("t.g") == F.col("b.grp"), F.col("t.bx") == F.col("b.gx"), F.col("t.by") == F.col("b.gy"), *[F.col(f"t.b_{s}") == F.col(f"b.{s}") for s in parent]]
        split = (todo.alias("t").join(boxes.alias("a"), aa).join(boxes.alias("b"), bb)
                 .select(*[F.col(f"t.{k}") for k in key], *[F.col(f"a.{s}").alias(f"a_{s}") for s in sub],
                         *[F.col(f"b.{s}").alias(f"b_{s}") for s in sub], (F.col("a.n") * F.col("b.n")).alias("work"),
                         _reach(False).alias("lo"), _reach(True).alias("hi")).filter(F.col("lo") <= r))
        split = cut(split)
        sure = split.filter(F.col("hi") <= r).select(*key).distinct()
        rest = split.join(sure, key, "left_anti")
        small = direct(rest.filter(F.col("work") <= PAIR_BUDGET), sub, pts)
        found = cut(sure.unionByName(small).distinct())
        linked = linked.unionByName(found)
        todo = cut(rest.filter(F.col("work") > PAIR_BUDGET).join(found, key, "left_anti")
                   .select(*key, *[f"a_{s}" for s in sub], *[f"b_{s}" for s in sub]))
        parent = sub
    return cells, linked


def link_points(points: DataFrame, r: float = 2.0, by: list[str] | None = None) -> DataFrame:
    """Add ``label`` (one value per single-link component) to points with ``x`` and ``y``.

    Points with different ``by`` values are never linked.
    """
    side = r * 0.7071
    grp = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in by]) if by else F.lit("")
    tagged = points.withColumn("grp", grp)
    cells, linked = linked_cells(tagged, r)

    def pack(*cols):
        return F.concat_ws(":", *[c.cast("string") for c in cols])

    labels = connected_components(
        cells.select(pack(F.col("grp"), F.col("gx"), F.col("gy")).alias("id")),
        linked.select(pack(F.col("g"), F.col("ax"), F.col("ay")).alias("a"), pack(F.col("g"), F.col("bx"), F.col("by")).alias("b")),
    )
    return (tagged.withColumn("id", pack(F.col("grp"), cell("x", side), cell("y", side)))
            .join(labels, "id").drop("id", "grp"))


def cluster_points(points: DataFrame, r: float = 2.0, view: str = "view", min_views: int = 2, by: list[str] | None = None) -> DataFrame:
    """Single-link clusters seen from at least ``min_views`` distinct views: centroid and member count."""
    keys = [*(by or []), "label"]
    linked = link_points(points, r, by)
    # combine per view first: distinct views then become a plain count
    per_view = linked.groupBy(*keys, view).agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count(F.lit(1)).alias("n"))
    out = per_view.groupBy(*keys).agg(F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.sum("n").alias("members"), F.count(view).alias("views"))
    return (out.filter(F.col("views") >= min_views)
            .select(*keys, (F.col("sx") / F.col("members")).alias("x"), (F.col("sy") / F.col("members")).alias("y"), "members", "views"))
