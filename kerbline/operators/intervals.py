"""One-dimensional interval algebra along kerbs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import col
from ..functions.text import parking_kind
from ..session import cut
from .scan import chunk_of

# Fixed values, metres: evidence cell, gaps that still count as one row of cars, manoeuvring room,
# car length, default place length; looks below which kerb counts as unseen.
CELL_M, JOIN_BELOW_M, CLEARANCE_M, CAR_M, DEFAULT_SPACE_M, MIN_VIEWS = 0.5, 1.5, 0.5, 4.4, 5.5, 3
CHUNK_M = 4.0


def _union(iv: DataFrame, keys: list[str], join_below: float) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("s0", "s1")
    reach = F.max("s1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = iv.withColumn("__new", F.when(reach.isNull() | (F.col("s0") - reach >= join_below), 1).otherwise(0))
    isles = marked.withColumn("__isle", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return isles.groupBy(*keys, "__isle").agg(F.min("s0").alias("s0"), F.max("s1").alias("s1")).drop("__isle")


def merge_intervals(df: DataFrame, by: list[str], s0: str = "s0", s1: str = "s1", join_below: float = JOIN_BELOW_M, chunk_m: float = CHUNK_M) -> DataFrame:
    """Union of intervals per group, joined while the gap is below ``join_below``.

    Intervals are normalised and copies dropped, then united inside stretches of ``chunk_m``, so a
    busy kerb is worked on in many tasks; what is left per kerb is disjoint and bounded by its length.
    """
    iv = df.select(*by, F.least(s0, s1).alias("s0"), F.greatest(s0, s1).alias("s1"))
    if join_below > 0:
        iv = iv.groupBy(*by, "s0").agg(F.max("s1").alias("s1"))
    else:
        iv = iv.distinct()
    local = _union(iv.withColumn("__chunk", chunk_of("s0", chunk_m)), [*by, "__chunk"], join_below).drop("__chunk")
    return _union(local, by, join_below)


def runs_of_true(cells: DataFrame, by: list[str], k: str = "k", cell: float = CELL_M, length: Column | str | None = None) -> DataFrame:
    """Neighbouring true cells joined to ``(s0, s1)``; ends never pass ``length``.

    Cells are made distinct first, so a group holds at most its length over the cell size.
    """
    keep = [F.max(col(length)).alias("__len")] if length is not None else []
    src = cells.groupBy(*by, F.col(k).cast("bigint").alias("k")).agg(*(keep or [F.count(F.lit(1)).alias("__len")]))
    w = Window.partitionBy(*by).orderBy("k")
    num = src.withColumn("isle", F.col("k") - F.row_number().over(w))
    out = num.groupBy(*by, "isle").agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.max("__len").alias("__len"))
    end = (F.col("k1") + 1) * F.lit(cell)
    if length is not None:
        end = F.least(end, F.col("__len"))
    return out.select(*by, (F.col("k0") * F.lit(cell)).alias("s0"), end.alias("s1"))


def interval_pairs(left: DataFrame, right: DataFrame, on: list[str], l: tuple[str, str], r: tuple[str, str], size: float = 25.0) -> DataFrame:
    """Touching intervals of the same key, each pair once, through shared stretches of ``size`` metres."""
    def spread(df, lo, hi):
        return df.withColumn("__c", F.explode(F.sequence(chunk_of(lo, size), F.greatest(chunk_of(lo, size), chunk_of(hi, size)))))

    a, b = spread(left, *l), spread(right, *r)
    out = a.join(b, [*on, "__c"])
    touch = (F.col(l[0]) <= F.col(r[1])) & (F.col(r[0]) <= F.col(l[1]))
    return out.filter(touch & (F.col("__c") == chunk_of(F.greatest(F.col(l[0]), F.col(r[0])), size))).drop("__c")


def vote_cells(runs: DataFrame, observed: DataFrame, occupied: DataFrame, cell: float = CELL_M, min_views: int = MIN_VIEWS) -> DataFrame:
    """``(run_id, k, looks, hits, is_observed, is_occupied)`` per half metre of kerb.

    A frame looks at a cell once and hits it only where it looked; occupied needs a strict majority
    of at least ``min_views`` looks.
    """
    length = runs.select("run_id", F.greatest(F.lit(1), F.ceil(F.col("length_m") / cell)).alias("__n"))

    def cells(iv, flag):
        lo = F.greatest(F.lit(0), F.floor(F.col("s0") / cell))
        hi = F.least(F.col("__n"), F.ceil(F.col("s1") / cell)) - 1
        c = iv.select("run_id", "frame_idx", "s0", "s1").join(length, "run_id").filter(lo <= hi)
        return c.select("run_id", "frame_idx", F.explode(F.sequence(lo, hi)).alias("k"), F.lit(flag).alias("occ"))

    per_frame = cells(observed, 0).unionByName(cells(occupied, 1)).groupBy("run_id", "frame_idx", "k").agg(F.min("occ").alias("lo"), F.max("occ").alias("hi"))
    votes = per_frame.filter("lo = 0").groupBy("run_id", "k").agg(F.count(F.lit(1)).alias("looks"), F.sum("hi").cast("bigint").alias("hits"))
    seen = F.col("looks") >= min_views
    return votes.withColumns({"is_observed": seen, "is_occupied": seen & (F.col("hits") * 2 > F.col("looks"))})


def car_intervals(cars: DataFrame, by: list[str], s: str = "s", car_m: float = CAR_M, join_below: float = JOIN_BELOW_M) -> DataFrame:
    """Stretches the counted cars take up, each car centred on its position."""
    ends = cars.select(*by, (F.col(s) - car_m / 2).alias("s0"), (F.col(s) + car_m / 2).alias("s1"))
    return merge_intervals(ends, by, join_below=join_below)


def space_of(runs: DataFrame) -> Column:
    pitch = F.col("pitch_m") if "pitch_m" in runs.columns else F.lit(None).cast("double")
    return F.coalesce(F.when(pitch > 0, pitch), F.lit(DEFAULT_SPACE_M))


def observed_or_whole(runs: DataFrame, observed: DataFrame | None) -> DataFrame:
    """Merged observed stretches; a run nobody reports on counts as wholly observed."""
    whole = runs.select("run_id", F.lit(0.0).alias("s0"), F.col("length_m").alias("s1"))
    if observed is None:
        return whole
    obs = merge_intervals(observed, ["run_id"], join_below=0.0)
    return obs.join(runs.select("run_id"), "run_id", "left_semi").unionByName(whole.join(obs.select("run_id").distinct(), "run_id", "left_anti"))


def gap_rows(runs: DataFrame, occupied: DataFrame, observed: DataFrame, clearance_m: float = CLEARANCE_M) -> DataFrame:
    """Free stretches of merged ``observed`` outside merged ``occupied``: ``(run_id, s0, s1, spaces)``.

    A stretch with cars on both sides gives up the manoeuvring room; only stretches that fit a car stay.
    """
    obs = observed.select("run_id", F.col("s0").alias("o0"), F.col("s1").alias("o1"))
    occ = occupied.select("run_id", F.col("s0").alias("a"), F.col("s1").alias("b"))
    inside = interval_pairs(obs, occ, ["run_id"], ("o0", "o1"), ("a", "b")).filter((F.col("b") > F.col("o0")) & (F.col("a") < F.col("o1")))
    clipped = inside.select("run_id", "o0", F.greatest("a", "o0").alias("a"), F.least("b", "o1").alias("b"))
    ends = obs.select("run_id", "o0", F.explode(F.array("o0", "o1")).alias("a")).withColumn("b", F.col("a"))
    # both inputs are merged, so one stretch holds no more rows than its length allows
    w = Window.partitionBy("run_id", "o0").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    seen = clipped.unionByName(ends).distinct().withColumn("reach", F.max("b").over(w))
    free = seen.filter(F.col("a") > F.col("reach")).select("run_id", F.col("reach").alias("s0"), F.col("a").alias("s1"))
    j = free.join(runs.select("run_id", F.col("length_m").alias("__len"), space_of(runs).alias("__space")), "run_id")
    interior = (F.col("s0") > 1e-6) & (F.col("s1") < F.col("__len") - 1e-6)
    room = F.col("s1") - F.col("s0") - F.when(interior, F.lit(clearance_m)).otherwise(0.0)
    return j.withColumn("spaces", F.floor(room / F.col("__space")).cast("bigint")).filter("spaces > 0").select("run_id", "s0", "s1", "spaces")


def free_gaps(runs: DataFrame, occupied: DataFrame, observed: DataFrame | None = None, clearance_m: float = CLEARANCE_M) -> tuple[DataFrame, DataFrame]:
    """``(per run, gaps)``: places free on observed kerb, never more than the run's capacity."""
    obs = cut(observed_or_whole(runs, observed))
    occ = cut(merge_intervals(occupied, ["run_id"]).join(runs.select("run_id"), "run_id", "left_semi"))
    gaps = cut(gap_rows(runs, occ, obs, clearance_m))
    n = gaps.groupBy("run_id").agg(F.sum("spaces").alias("__free"))
    ol = obs.groupBy("run_id").agg(F.sum(F.col("s1") - F.col("s0")).alias("__obs"))
    cl = occ.groupBy("run_id").agg(F.sum(F.col("s1") - F.col("s0")).alias("__occ"))
    j = runs.join(n, "run_id", "left").join(ol, "run_id", "left").join(cl, "run_id", "left")
    raw = F.coalesce("__free", F.lit(0)).cast("bigint")
    per = j.select(
        "run_id", "capacity", F.least(raw, F.coalesce("capacity", raw)).alias("free"), (raw > F.coalesce("capacity", raw)).alias("capped"),
        F.round(F.coalesce("__occ", F.lit(0.0)), 2).alias("occupied_len_m"), F.round(F.coalesce("__obs", F.lit(0.0)), 2).alias("observed_len_m"),
        F.when(F.col("length_m") > 0, F.round(F.coalesce("__obs", F.lit(0.0)) / F.col("length_m"), 3)).otherwise(0.0).alias("observed_fraction"),
        F.round("length_m", 2).alias("length_m"), F.round(space_of(runs), 2).alias("space_m"))
    shown = gaps.select("run_id", F.round("s0", 2).alias("s0"), F.round("s1", 2).alias("s1"), F.round(F.col("s1") - F.col("s0"), 2).alias("len_m"), "spaces")
    return per, shown


def run_summary(runs: DataFrame, cars: DataFrame, observed: DataFrame | None, car_m: float = CAR_M) -> tuple[DataFrame, DataFrame]:
    """``(per run, gaps)``: counted cars on observed kerb, and what still fits between them.

    Capacity shrinks to the observed share; ``free`` is measured from gaps and never above it.
    """
    obs = cut(observed_or_whole(runs, observed))
    held = (cars.select("run_id", "s").join(runs.select("run_id", F.col("length_m").alias("__len")), "run_id")
            .withColumn("at", F.least(F.col("s"), F.col("__len") - 1e-9)).groupBy("run_id", "s", "at").agg(F.count(F.lit(1)).alias("n")))
    o = obs.select("run_id", F.col("s0").alias("o0"), F.col("s1").alias("o1"))
    on = (interval_pairs(held.withColumn("at1", F.col("at")), o, ["run_id"], ("at", "at1"), ("o0", "o1"))
          .filter((F.col("o0") <= F.col("at")) & (F.col("at") < F.col("o1"))).select("run_id", "s", "n").distinct())
    held, on = cut(held), cut(on)
    occ = car_intervals(on, ["run_id"], car_m=car_m)
    per, gaps = free_gaps(runs, occ, obs)
    counts = held.groupBy("run_id").agg(F.sum("n").alias("__all")).join(on.groupBy("run_id").agg(F.sum("n").alias("__on")), "run_id", "left")
    ol = obs.groupBy("run_id").agg(F.sum(F.col("s1") - F.col("s0")).alias("__obs"))
    j = per.join(counts, "run_id", "left").join(ol, "run_id", "left").join(runs.select("run_id", space_of(runs).alias("__space")), "run_id")
    zero = F.lit(0).cast("bigint")
    fit = F.bround(F.col("__obs") / F.col("__space")).cast("bigint")
    cap = F.least(fit, F.coalesce(F.when(F.col("capacity") > 0, F.col("capacity")), fit))
    n_on, n_all = F.coalesce("__on", zero), F.coalesce("__all", zero)
    out = j.select("run_id", "capacity", cap.alias("capacity_observed"), n_on.alias("cars"), (n_all - n_on).alias("cars_off_observed"),
                   F.least("free", cap).alias("free"), F.greatest(zero, cap - n_on).alias("free_by_subtraction"),
                   "occupied_len_m", "observed_len_m", "observed_fraction", "length_m", "space_m")
    return out, gaps


def segment_overlap(intervals: DataFrame, segments: DataFrame) -> DataFrame:
    """Metres of ``(run_id, s0, s1)`` inside each ``(run_id, seg, a, b)``; zero where nothing touches."""
    pair = interval_pairs(segments, intervals, ["run_id"], ("a", "b"), ("s0", "s1"))
    part = F.greatest(F.lit(0.0), F.least("b", "s1") - F.greatest("a", "s0"))
    got = pair.groupBy("run_id", "seg").agg(F.sum(part).alias("overlap_m"))
    return segments.join(got, ["run_id", "seg"], "left").withColumn("overlap_m", F.coalesce("overlap_m", F.lit(0.0)))


def segment_counts(points: DataFrame, segments: DataFrame, name: str = "cars") -> DataFrame:
    """Positions ``(run_id, s)`` with ``a <= s < b`` per segment."""
    held = points.groupBy("run_id", "s").agg(F.count(F.lit(1)).alias("__n")).withColumn("__e", F.col("s"))
    pair = interval_pairs(segments, held, ["run_id"], ("a", "b"), ("s", "__e")).filter(F.col("s") < F.col("b"))
    got = pair.groupBy("run_id", "seg").agg(F.sum("__n").alias(name))
    return segments.join(got, ["run_id", "seg"], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def segments(runs: DataFrame, piece_m: float = 18.0) -> DataFrame:
    """Each run in equal pieces of at most ``piece_m``: ``(run_id, seg, a, b)``."""
    n = F.greatest(F.lit(1), F.ceil(F.col("length_m") / piece_m)).cast("int")
    base = runs.select("run_id", "length_m", n.alias("n")).withColumn("seg", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    piece = F.col("length_m") / F.col("n")
    return base.select("run_id", "seg", (F.col("seg") * piece).alias("a"), ((F.col("seg") + 1) * piece).alias("b"))


def plausibility_gate(counted: DataFrame, runs: DataFrame, parallel_m: float = 4.0, across_m: float = 2.2) -> tuple[DataFrame, DataFrame]:
    """``(kept, dropped)``: counts denser than cars can stand are dropped; skipped and uncounted ones are neither."""
    scored = counted.filter(~F.coalesce(F.col("skip"), F.lit(False)) & F.col("count").isNotNull()).join(runs.select("run_id", "park_txt"), "run_id", "left")
    floor = F.when(parking_kind("park_txt") == "perpendicular", across_m).otherwise(parallel_m)
    dense = F.col("park_txt").isNotNull() & (F.col("count") > 0) & ((F.col("s1") - F.col("s0")) / F.nullif(F.col("count"), F.lit(0)) < floor)
    tagged = scored.withColumn("dense", F.coalesce(dense, F.lit(False)))
    return tagged.filter(~F.col("dense")).drop("dense"), tagged.filter("dense").drop("dense")
