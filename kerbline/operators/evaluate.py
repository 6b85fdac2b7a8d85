"""Scoring detections and verdicts against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo
from ..functions.numeric import count_if, ratio
from ..session import cut
from .evidence import view_distances
from .scan import global_number, ordered_scan
from .spatial import box_pairs, nearest
from .stats import confusion_counts, score

CORNERS = ("x0", "y0", "x1", "y1")


def _distinct(df: DataFrame, side: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Boxes of a frame with their number ``<side>_n`` and what ``extra`` gathers over the copies."""
    one = df.groupBy("frame", *CORNERS).agg(F.count(F.lit(1)).alias(f"{side}_n"), *[e.alias(n) for n, e in (extra or {}).items()])
    return one.withColumnsRenamed({c: f"{side}_{c}" for c in CORNERS})


def overlap_pairs(dets: DataFrame, gts: DataFrame, iou: float = 0.5, size: float = 128.0, of_dets: dict[str, Column] | None = None,
                  of_gts: dict[str, Column] | None = None) -> DataFrame:
    """Pairs of distinct boxes of a frame with at least ``iou`` overlap: ``frame, d_*, g_*, d_n, g_n, iou``.

    Copies of a box are one row that carries their number and the given aggregates, so nothing grows with the product of copies.
    """
    d, g = _distinct(dets, "d", of_dets), _distinct(gts, "g", of_gts)
    p = box_pairs(d, g, tuple(f"d_{c}" for c in CORNERS), tuple(f"g_{c}" for c in CORNERS), size, on=["frame"])
    v = geo.iou({c: F.col(f"d_{c}") for c in CORNERS}, {c: F.col(f"g_{c}") for c in CORNERS})
    return p.withColumn("iou", v).filter(F.col("iou") >= iou)


def _reached(pairs: DataFrame, side: str, **aggs: Column) -> DataFrame:
    """Distinct boxes of one side that any other overlaps, with their number ``n``."""
    return pairs.groupBy("frame", *[F.col(f"{side}_{c}").alias(c) for c in CORNERS]).agg(F.max(f"{side}_n").alias("n"), *[e.alias(k) for k, e in aggs.items()])


def _copies(when: Column) -> Column:
    """How many boxes, copies counted, hold ``when``."""
    return F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))


def claim_in_order(pairs: DataFrame, who: str, what: str, prefer: str, priority: str) -> DataFrame:
    """One-to-one claims as if ``who`` came one by one in ``priority`` order, each taking its best free ``what``.

    A claim is final once nobody earlier still wants the same thing, so whole rounds of claims settle
    together; the number of rounds is the longest chain of rivals, not the number of rows.
    """
    left = cut(pairs.select(who, what, prefer, priority))
    done = None
    while True:
        best = left.groupBy(who).agg(F.min(F.struct(prefer, what)).alias("b")).select(who, F.col(f"b.{what}").alias(what))
        first = left.groupBy(what).agg(F.min(F.struct(priority, who)).alias("f")).select(F.col(f"f.{who}").alias(who), what)
        won = cut(best.join(first, [who, what]))
        if won.isEmpty():
            break
        done = won if done is None else done.unionByName(won)
        left = cut(left.join(won.select(who), who, "left_anti").join(won.select(what), what, "left_anti"))
    return done if done is not None else left.select(who, what)


# Numbers per chunk when suitors of one box are ranked.
CHUNK = 1 << 16


def _fill(pairs: DataFrame) -> DataFrame:
    """``(turn, kind)``: who come in the order of ``turn`` take a place of the ``kind`` they prefer that has one free.

    ``pairs`` is ``turn, kind, prefer, room`` (places of the kind).  A claim is final once everybody earlier who could still want the
    kind leaves a place, so all such claims settle together, copies too; the rounds are the longest chain of rivals.
    """
    left, done = cut(pairs), None
    first = Window.partitionBy("turn").orderBy("prefer", "kind")
    while True:
        ranked = ordered_scan(left, ["kind"], ["turn"], F.floor(F.col("turn") / CHUNK).cast("bigint"), row_number="rank")
        won = cut(ranked.withColumn("choice", F.row_number().over(first)).filter((F.col("choice") == 1) & (F.col("rank") <= F.col("room"))).select("turn", "kind"))
        if won.isEmpty():
            return won if done is None else done
        done = won if done is None else done.unionByName(won)
        taken = cut(won.groupBy("kind").agg(F.count(F.lit(1)).alias("taken")))
        rest = left.join(won.select("turn"), "turn", "left_anti").join(taken, "kind", "left")
        left = cut(rest.withColumn("room", F.col("room") - F.coalesce("taken", F.lit(0))).filter("room > 0").drop("taken"))


def match_boxes_greedy(dets: DataFrame, gts: DataFrame, iou: float = 0.5) -> DataFrame:
    """``(frame, det, gt)`` of detections, most confident first, taking their best unused truth box.

    Copies of a truth box are one kind with as many places; its takers get the copies in the order of their ids.  Of kinds that overlap
    alike the one with the least id comes first.
    """
    kinds = gts.groupBy("frame", *CORNERS).agg(F.min("box_id").alias("first")).select("frame", *CORNERS, F.struct("frame", F.col("first").alias("kind")).alias("kind"))
    turns = cut(global_number(dets.select("frame", "box_id", "conf", *CORNERS), [-F.col("conf"), "frame", "box_id"], "turn"))
    p = overlap_pairs(dets, gts, iou, of_gts={"first": F.min("box_id")})
    wish = p.select("frame", *[F.col(f"d_{c}").alias(c) for c in CORNERS], F.struct("frame", F.col("first").alias("kind")).alias("kind"), (-F.col("iou")).alias("prefer"), F.col("g_n").alias("room"))
    got = _fill(turns.join(wish, ["frame", *CORNERS]).select("turn", "kind", "prefer", "room"))
    takers = ordered_scan(got, ["kind"], ["turn"], F.floor(F.col("turn") / CHUNK).cast("bigint"), row_number="place").join(turns.select("turn", F.col("box_id").alias("det")), "turn")
    copies = global_number(gts.select("frame", "box_id", *CORNERS), ["frame", "box_id", *CORNERS], "n").join(cut(kinds), ["frame", *CORNERS])
    places = ordered_scan(copies, ["kind"], ["n"], F.floor(F.col("n") / CHUNK).cast("bigint"), row_number="place").select("kind", "place", F.col("box_id").alias("gt"))
    return takers.join(places, ["kind", "place"]).select("kind.frame", "det", "gt")


def greedy_score(dets: DataFrame, gts: DataFrame, matches: DataFrame) -> DataFrame:
    from .serve import side_by_side

    n = side_by_side(matches.agg(F.count(F.lit(1)).alias("tp")), dets.agg(F.count(F.lit(1)).alias("__d")), gts.agg(F.count(F.lit(1)).alias("__g")))
    n = n.withColumns({"fp": F.col("__d") - F.col("tp"), "fn": F.col("__g") - F.col("tp")}).drop("__d", "__g")
    return n.withColumns({"precision": F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 4), "recall": F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 4)})


def match_boxes_any(dets: DataFrame, gts: DataFrame, labelled: DataFrame, iou: float = 0.5, classes: dict[str, list[str]] | None = None) -> DataFrame:
    """Per class set: truth boxes any detection reaches, detections made, recall and precision; one pass for all sets.

    Frames without a label file take no part.
    """
    from .serve import side_by_side

    frames = labelled.select("frame").distinct()
    d, g = dets.join(frames, "frame", "left_semi"), gts.join(frames, "frame", "left_semi")
    sets = list((classes or {"any": None}).items())
    holds = [F.lit(True) if members is None else F.coalesce(F.col("cls").isin(members), F.lit(False)) for _, members in sets]
    pairs = overlap_pairs(d, g, iou, of_dets={f"s{i}": F.bool_or(h) for i, h in enumerate(holds)})
    hits = _reached(pairs, "g", **{f"s{i}": F.bool_or(f"s{i}") for i in range(len(sets))}).agg(*[_copies(F.col(f"s{i}")).alias(f"h{i}") for i in range(len(sets))])
    row = side_by_side(hits, g.agg(F.count(F.lit(1)).alias("truth")), d.agg(*[count_if(h).alias(f"m{i}") for i, h in enumerate(holds)]))
    cells = F.array(*[F.struct(F.lit(name).alias("classes"), F.col(f"h{i}").alias("hits"), F.col(f"m{i}").alias("made")) for i, (name, _) in enumerate(sets)])
    out = row.select("truth", F.explode(cells).alias("c")).select("c.classes", "c.hits", "truth", "c.made")
    return out.withColumns({"recall": F.round(ratio("hits", "truth"), 4), "precision": F.round(ratio("hits", "made"), 4)})


def conf_sweep(dets: DataFrame, gts: DataFrame, thresholds: list[float], iou: float = 0.5) -> DataFrame:
    """Precision and recall at every confidence threshold from one set of overlap pairs."""
    from .serve import side_by_side

    best = _reached(overlap_pairs(dets, gts, iou, of_dets={"conf": F.max("conf")}), "g", conf=F.max("conf"))
    steps = list(enumerate(thresholds))
    hits = best.agg(*[_copies(F.col("conf") >= t).alias(f"h{i}") for i, t in steps])
    made = dets.agg(*[count_if(F.col("conf") >= t).alias(f"m{i}") for i, t in steps])
    row = side_by_side(hits, made, gts.agg(F.count(F.lit(1)).alias("truth")))
    cells = F.array(*[F.struct(F.lit(float(t)).alias("conf"), F.col(f"h{i}").alias("hits"), F.col(f"m{i}").alias("made")) for i, t in steps])
    out = row.select("truth", F.explode(cells).alias("c")).select("c.conf", "c.hits", "c.made", "truth")
    return out.withColumns({"precision": F.round(ratio("hits", "made"), 4), "recall": F.round(ratio("hits", "truth"), 4)})


def correction_stats(pred: DataFrame, corrected: DataFrame, iou: float = 0.5, nudged: float = 0.85) -> DataFrame:
    """Per split: boxes kept (and nudged), deleted and drawn when people corrected predictions.

    Both tables carry ``frame, split, box_id`` and corners.
    """
    p = cut(overlap_pairs(pred, corrected, iou))
    box = ["frame", *CORNERS]
    truth = corrected.groupBy("split", *box).agg(F.count(F.lit(1)).alias("n")).join(_reached(p, "g", iou=F.max("iou")).drop("n"), box, "left")
    made = pred.groupBy("split", *box).agg(F.count(F.lit(1)).alias("n")).join(_reached(p, "d", iou=F.max("iou")).drop("n"), box, "left")
    a = truth.groupBy("split").agg(F.sum("n").alias("cars"), _copies(F.col("iou").isNotNull()).alias("kept"), _copies(F.col("iou") < nudged).alias("nudged"),
                                   _copies(F.col("iou").isNull()).alias("drawn"))
    b = made.groupBy("split").agg(F.sum("n").alias("predicted"), _copies(F.col("iou").isNull()).alias("deleted"))
    frames = pred.select("frame", "split").unionByName(corrected.select("frame", "split")).distinct().groupBy("split").agg(F.count(F.lit(1)).alias("frames"))
    j = frames.join(a, "split", "left").join(b, "split", "left").na.fill(0)
    return j.withColumns({"edits_per_frame": F.round(ratio(F.col("drawn") + F.col("deleted"), F.col("frames")), 3),
                          "precision": F.round(ratio(F.col("predicted") - F.col("deleted"), F.col("predicted")), 4), "recall": F.round(ratio("kept", "cars"), 4)})


def nms(dets: DataFrame, thr: float = 0.5, size: float = 128.0) -> DataFrame:
    """Detections that survive suppression by a more confident, overlapping survivor of their frame.

    Copies of a box shrink to the most confident one first.  Each round keeps every box no undecided
    box outranks and drops what those overlap.
    """
    rank = F.struct((-F.col("conf")).alias("c"), F.col("box_id").alias("b"))
    one = dets.groupBy("frame", *CORNERS).agg(F.min(rank).alias("rank"))
    left = one.select("frame", F.col("rank").alias("ra"), *[F.col(c).alias(f"a_{c}") for c in CORNERS])
    right = one.select("frame", F.col("rank").alias("rb"), *[F.col(c).alias(f"b_{c}") for c in CORNERS])
    p = box_pairs(left, right, tuple(f"a_{c}" for c in CORNERS), tuple(f"b_{c}" for c in CORNERS), size, on=["frame"])
    v = geo.iou({c: F.col(f"a_{c}") for c in CORNERS}, {c: F.col(f"b_{c}") for c in CORNERS})
    beats = cut(p.filter((F.col("ra") < F.col("rb")) & (v > thr)).select("frame", F.col("ra.b").alias("hi"), F.col("rb.b").alias("lo")))
    dropped = None
    while not beats.isEmpty():
        safe = beats.select("frame", F.col("hi").alias("id")).distinct().join(beats.select("frame", F.col("lo").alias("id")).distinct(), ["frame", "id"], "left_anti")
        out = cut(beats.join(safe.withColumnRenamed("id", "hi"), ["frame", "hi"]).select("frame", F.col("lo").alias("id")).distinct())
        dropped = out if dropped is None else dropped.unionByName(out)
        gone = out.withColumnRenamed("id", "hi")
        beats = cut(beats.join(out.withColumnRenamed("id", "lo"), ["frame", "lo"], "left_anti").join(gone, ["frame", "hi"], "left_anti")
                    .join(safe.withColumnRenamed("id", "hi"), ["frame", "hi"], "left_anti"))
    kept = one.select("frame", F.col("rank.b").alias("box_id"))
    if dropped is not None:
        kept = kept.join(dropped.withColumnRenamed("id", "box_id"), ["frame", "box_id"], "left_anti")
    return dets.join(kept, ["frame", "box_id"], "left_semi")


def tile_grid(images: DataFrame, n: int, overlap: float = 0.2) -> DataFrame:
    """``n x n`` overlapping crops of each picture ``(frame, w, h)``."""
    span = n - (n - 1) * overlap
    tw, th = F.floor(F.col("w") / span).cast("int"), F.floor(F.col("h") / span).cast("int")
    sx, sy = F.floor(tw * (1 - overlap)).cast("int"), F.floor(th * (1 - overlap)).cast("int")
    k = F.array(*[F.lit(i) for i in range(n)])
    t = images.withColumn("i", F.explode(k)).withColumn("j", F.explode(k))
    x0, y0 = F.least(F.col("i") * sx, F.col("w") - tw), F.least(F.col("j") * sy, F.col("h") - th)
    return t.select("frame", "i", "j", x0.alias("x0"), y0.alias("y0"), (x0 + tw).alias("x1"), (y0 + th).alias("y1"))


def match_drawings(drawn: DataFrame, bays: DataFrame, max_m: float = 6.0) -> tuple[DataFrame, DataFrame]:
    """``(matched, orphans)``: drawings, most votes first, claim the nearest bay nobody took within ``max_m``.

    Ties go to the least drawing id and bay id; orphans carry the distance to the nearest bay of all.
    """
    d = drawn.select("drawing_id", "votes", F.col("x").alias("dx"), F.col("y").alias("dy"))
    b = bays.select("bay_id", "x", "y")
    near = box_pairs(d, b, ("dx", "dy", "dx", "dy"), ("x", "y", "x", "y"), 2 * max_m, reach=max_m)
    near = cut(near.withColumn("dist", geo.distance("dx", "dy", "x", "y")).filter(F.col("dist") <= max_m))
    keyed = near.select("drawing_id", "bay_id", "dist", F.struct((-F.col("votes")).alias("v"), F.col("drawing_id").alias("d")).alias("priority"))
    got = claim_in_order(keyed, "drawing_id", "bay_id", "dist", "priority").join(near.select("drawing_id", "bay_id", "dist"), ["drawing_id", "bay_id"])
    rest = drawn.join(got, "drawing_id", "left_anti")
    far = nearest(rest, bays, "drawing_id", "bay_id", "x", "y", "x", "y", size=2 * max_m).select("drawing_id", F.col("dist").alias("nearest_m"))
    return got, rest.join(far, "drawing_id", "left")


def radius_sweep(dets: DataFrame, views: DataFrame, labels: DataFrame, radii: list[float]) -> DataFrame:
    """Confusion per radius and assignment rule from one pass over detection-bay distances."""
    d = view_distances(dets, views, max(radii))
    steps = F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.lit(rule).alias("rule")) for r in radii for rule in ("inclusive", "nearest")])
    hit = F.when(F.col("s.rule") == "inclusive", F.col("near_any")).otherwise(F.col("near_own")) <= F.col("s.radius")
    e = d.withColumn("s", F.explode(steps)).select("bay_id", "s.radius", "s.rule", F.coalesce(hit, F.lit(False)).alias("hit"))
    voted = e.groupBy("bay_id", "radius", "rule").agg((count_if(F.col("hit")) * 2 > F.count(F.lit(1))).alias("occupied"))
    j = voted.join(labels.filter("gt is not null").select("bay_id", "gt"), "bay_id")
    return score(j.groupBy("radius", "rule").agg(*confusion_counts()[:4]))


def best_setting(sweep: DataFrame) -> DataFrame:
    """Most accurate setting; ties to the least radius, then rule."""
    return sweep.agg(F.min_by(F.struct(*sweep.columns), F.struct(-F.col("accuracy"), "radius", "rule")).alias("b")).select("b.*")
