"""Kerb runs: chaining bays, building lines, registering and re-deriving their state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geo
from ..functions.numeric import within_window
from ..session import cut
from . import intervals
from .components import cluster_points, connected_components
from .scan import chunk_of, ordered_scan
from .spatial import box_pairs, locate, nearest
from .stats import majority_attr, percentiles
from .vote import newest_mission

# Chaining limits (metres, cosine) and the least run with a trusted axis.
ALONG_M, LATERAL_M, BEARING_COS, MIN_RUN = 9.0, 2.0, 0.95, 4


def chain_bays(bays: DataFrame, along_m: float = ALONG_M, lateral_m: float = LATERAL_M, bearing_cos: float = BEARING_COS) -> DataFrame:
    """``(bay_id, label)``: bays in line with each other along the kerb.

    ``bays``: ``bay_id, ord, x, y, ux, uy``.  A link is measured in the frame of the bay that comes
    first by ``ord``.  Bays with equal position and direction are one node (any two of them link);
    between two such piles a frame counts when some bay of it precedes some bay of the other.
    """
    pos = ["x", "y", "ux", "uy"]
    piles = bays.groupBy(*pos).agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    side = max(along_m, lateral_m)
    a = piles.select(*[F.col(c).alias(f"a_{c}") for c in [*pos, "lo", "hi"]])
    b = piles.select(*[F.col(c).alias(f"b_{c}") for c in [*pos, "lo", "hi"]])
    # a link reaches along and across at most, so its ends are within the diagonal
    reach = (along_m ** 2 + lateral_m ** 2) ** 0.5
    near = box_pairs(a, b, ("a_x", "a_y", "a_x", "a_y"), ("b_x", "b_y", "b_x", "b_y"), 2 * side, reach=reach).filter("a_lo < b_lo")
    vx, vy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    aligned = F.abs(F.col("a_ux") * F.col("b_ux") + F.col("a_uy") * F.col("b_uy")) >= bearing_cos

    def fits(p):
        ux, uy = F.col(f"{p}_ux"), F.col(f"{p}_uy")
        return (F.abs(vx * ux + vy * uy) <= along_m) & (F.abs(vy * ux - vx * uy) <= lateral_m)

    link = aligned & (fits("a") | (fits("b") & (F.col("b_lo") < F.col("a_hi"))))
    edges = near.filter(link).select(F.col("a_lo").alias("a"), F.col("b_lo").alias("b"))
    labels = connected_components(piles.select(F.col("lo").alias("id")), edges)
    first = bays.join(piles.select(*pos, "lo").hint("merge"), pos)
    return first.join(labels.hint("merge"), first["lo"] == labels["id"]).select("bay_id", "label")


def build_runs(bays: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(runs, members)`` from chained bays.

    ``members``: ``run_id, seq, bay_id, x, y, s`` in order along the main axis; ``s`` counts from the
    start of the extended line.  Capacity is the number of bays, never length over pitch; the line is
    half a pitch longer at both ends; attributes are the most common ones.
    """
    m = cut(bays.join(chains, "bay_id"))
    # positions count from the first bay: far from the origin the spread of a straight row would drown in rounding and turn its axis round
    first = m.groupBy("label").agg(F.min_by(F.struct("x", "y"), "ord").alias("o"))
    m = m.join(first, "label").withColumns({"rx": F.col("x") - F.col("o.x"), "ry": F.col("y") - F.col("o.y")}).drop("o")
    axis = m.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rx").alias("mx"), F.avg("ry").alias("my"), F.var_pop("rx").alias("vx"), F.var_pop("ry").alias("vy"),
        F.covar_pop("rx", "ry").alias("cxy"), F.min_by(F.struct("ux", "uy"), "ord").alias("own"))
    # the direction of greatest spread is half the angle of the doubled covariance; it points to positive y
    turn = F.atan2(2 * F.col("cxy"), F.col("vx") - F.col("vy")) / 2
    up = F.when(F.sin(turn) < 0, -1.0).otherwise(1.0)
    axis = axis.withColumns({"ax": F.when(F.col("n") == 1, F.col("own.ux")).otherwise(up * F.cos(turn)), "ay": F.when(F.col("n") == 1, F.col("own.uy")).otherwise(up * F.sin(turn))})
    m, axis = cut(m), cut(axis)
    placed = m.join(axis.select("label", "mx", "my", "ax", "ay"), "label").withColumn(
        "proj", (F.col("rx") - F.col("mx")) * F.col("ax") + (F.col("ry") - F.col("my")) * F.col("ay"))
    chunk = chunk_of("proj", 200.0)
    seq = ordered_scan(placed, ["label"], ["proj", "ord"], chunk, lag={"px": "x", "py": "y"}, row_number="seq")
    gap = F.when(F.col("px").isNotNull(), geo.distance("px", "py", "x", "y"))
    seq = cut(seq.withColumn("gap", gap))
    pitch = percentiles(seq.filter("gap is not null"), ["label"], "gap", {"pitch": (0.5, "upper_median")})
    along = ordered_scan(seq, ["label"], ["proj", "ord"], chunk, running_sum={"run_s": F.coalesce("gap", F.lit(0.0))})
    ids = F.concat(F.lit("run_"), F.col("label").cast("string"))
    total = along.groupBy("label").agg(F.max("run_s").alias("len"))
    runs = axis.join(total, "label").join(pitch, "label", "left")
    for attr in ("street", "zona", "park_txt"):
        runs = runs.join(majority_attr(m, ["label"], attr), "label", "left")
    out = runs.select(
        ids.alias("run_id"), "label", "street", "zona", "park_txt", F.col("n").alias("capacity"), F.round("pitch", 3).alias("pitch_m"),
        F.round(F.col("len") + F.coalesce("pitch", F.lit(0.0)), 2).alias("length_m"),
        F.pmod(F.round(F.degrees(F.atan2("ay", "ax")), 1), F.lit(180.0)).alias("bearing_deg"), (F.col("n") >= MIN_RUN).alias("verified"))
    members = along.join(pitch, "label", "left").select(
        ids.alias("run_id"), "seq", "bay_id", "x", "y", (F.col("run_s") + F.coalesce("pitch", F.lit(0.0)) / 2).alias("s"))
    return out, members


def run_lines(members: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs with their polyline as one array (for files and maps); each end lies half a pitch beyond the last bay.

    An end is a row without a row before or behind it; it moves away from its only neighbour.
    """
    near = ordered_scan(members, ["run_id"], ["seq"], chunk_of("seq", 1000.0), lag={"before": F.struct("x", "y")}, lead={"behind": F.struct("x", "y")})
    from_ = F.when(F.col("before").isNull(), F.col("behind")).when(F.col("behind").isNull(), F.col("before"))
    step = near.join(runs.select("run_id", F.coalesce("pitch_m", F.lit(0.0)).alias("pitch")), "run_id").withColumn("near", from_)
    dist = F.nullif(geo.distance("near.x", "near.y", "x", "y"), F.lit(0.0))
    moved = {c: F.col(c) + F.coalesce((F.col(c) - F.col(f"near.{c}")) / dist * F.col("pitch") / 2, F.lit(0.0)) for c in ("x", "y")}
    pts = step.select("run_id", "seq", *[e.alias(c) for c, e in moved.items()]).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))
    return runs.join(pts, "run_id").withColumn("line", F.transform("v", lambda p: geo.point(p.x, p.y))).drop("v")


def shift_lateral(line, delta):
    """Line moved ``delta`` metres to the left, every vertex along the normal of the piece it starts."""
    def moved(pts):
        def one(p, i):
            j = F.least(i, F.size(pts) - 2)
            a, b = F.get(pts, j), F.get(pts, j + 1)
            d = F.coalesce(F.nullif(geo.distance(a.x, a.y, b.x, b.y), F.lit(0.0)), F.lit(1.0))
            return geo.point(p.x - (b.y - a.y) / d * delta, p.y + (b.x - a.x) / d * delta)

        return F.transform(pts, one)

    return geo.let(line, moved)


def lateral_fit(points: DataFrame, segments: DataFrame, runs: DataFrame, max_m: float = 6.0, min_n: int = 5) -> DataFrame:
    """``(run_id, delta, n, mad)``: how far each kerb lies beside the cars seen on it.

    Median and spread are upper medians; fewer than ``min_n`` points give 0 and no spread.
    """
    near = cut(locate(points, segments, "event_id", "x", "y", "run_id", max_m))
    med = percentiles(near, ["run_id"], "lateral", {"med": (0.5, "upper_median")}, extra=[F.max("size").alias("n")])
    dev = near.join(med.select("run_id", "med"), "run_id").withColumn("dev", F.abs(F.col("lateral") - F.col("med")))
    mad = percentiles(dev, ["run_id"], "dev", {"mad": (0.5, "upper_median")})
    j = runs.select("run_id").join(med, "run_id", "left").join(mad, "run_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return j.select("run_id", F.when(n >= min_n, F.col("med")).otherwise(0.0).alias("delta"), n.alias("n"), F.when(n >= min_n, F.col("mad")).alias("mad"))


def arclength(points: DataFrame, by: list[str], order: str, chunk: int = 4096) -> DataFrame:
    """Add ``s``, the distance travelled from the first point of the group."""
    prev = ordered_scan(points, by, [order], chunk_of(order, chunk), lag={"__px": "x", "__py": "y"})
    step = F.coalesce(geo.distance("__px", "__py", "x", "y"), F.lit(0.0))
    return ordered_scan(prev, by, [order], chunk_of(order, chunk), running_sum={"s": step}).drop("__px", "__py")


def recompute_run_states(dets: DataFrame, spans: DataFrame, runs: DataFrame, segments: DataFrame, as_of, window_s: float,
                         cluster_m: float = 2.0, min_views: int = 2, max_m: float = 6.0) -> tuple[DataFrame, DataFrame]:
    """``(per run, gaps)`` from the newest mission that looked at each kerb inside the window.

    ``dets``: ``run_id, mission_id, frame_idx, x, y, observed_at``; ``spans`` likewise with ``s0, s1``.
    """
    newest = cut(newest_mission(spans, "run_id", as_of, window_s, []).select("run_id", F.col("mission_id").alias("__m")))

    def current(df):
        return (df.filter(within_window("observed_at", as_of, window_s)).join(newest, "run_id")
                .filter(F.col("mission_id").eqNullSafe(F.col("__m"))).drop("__m"))

    mine, seen = cut(current(dets)), current(spans)
    cars = cluster_points(mine.withColumnRenamed("frame_idx", "view"), cluster_m, "view", min_views, by=["run_id"])
    # a mean depends on the order of its sum: kept to 1e-9 m, so that a gap of exactly so many places counts alike in every run
    cars = cars.withColumns({"car": F.concat_ws("|", "run_id", "label"), "x": F.round("x", 9), "y": F.round("y", 9)})
    on = locate(cars.select("car", "run_id", "x", "y"), segments, "car", "x", "y", "run_id", max_m, same_key=True)
    live = runs.join(newest.select("run_id"), "run_id", "left_semi")
    # and so does the place along the kerb, which parts and sums of a line would leave a last bit beside the mean; the end is the length itself
    at = F.when(F.col("s") > F.col("length_m") - 5e-10, F.col("length_m")).otherwise(F.round("s", 9))
    on = on.join(runs.select("run_id", "length_m"), "run_id").select("run_id", at.alias("s"))
    per, gaps = intervals.run_summary(live, on, seen)
    return per.join(newest.select("run_id", F.col("__m").alias("mission_id")), "run_id"), gaps


def bay_slots(runs: DataFrame) -> DataFrame:
    """Bay ``k`` of a run takes ``[k*pitch, (k+1)*pitch]``; runs without pitch or bays give none."""
    src = runs.filter(F.col("pitch_m") > 0).select("run_id", "pitch_m", F.posexplode("bay_ids").alias("k", "bay_id"))
    return src.select("run_id", "bay_id", (F.col("k") * F.col("pitch_m")).alias("s0"), ((F.col("k") + 1) * F.col("pitch_m")).alias("s1"))


def nearest_gap(points: DataFrame, gaps: DataFrame, states: DataFrame, lines: DataFrame, size: float = 50.0) -> DataFrame:
    """``(point_id, target, run_id, s, dist)``: middle of the nearest gap that fits a car.

    Only when no gap exists anywhere do runs that report free places without gaps stand in, by their middle.
    """
    from .geometry import point_at, polyline_length

    spots = gaps.filter("spaces > 0").join(lines.select("run_id", "line"), "run_id").select(
        F.concat("run_id", F.lit("@"), F.col("s0").cast("string")).alias("target"), "run_id", ((F.col("s0") + F.col("s1")) / 2).alias("s"), "line")
    if spots.isEmpty():
        bare = states.filter("free > 0").join(gaps.select("run_id").distinct(), "run_id", "left_anti").join(lines.select("run_id", "line"), "run_id")
        spots = bare.select(F.concat("run_id", F.lit("@run")).alias("target"), "run_id", (polyline_length(F.col("line")) / 2).alias("s"), "line")
    spots = spots.withColumn("p", point_at(F.col("line"), F.col("s"))).select("target", "run_id", "s", F.col("p.x").alias("gx"), F.col("p.y").alias("gy"))
    near = nearest(points, spots, "point_id", "target", "x", "y", "gx", "gy", size=size)
    return near.join(spots.select("target", "run_id", "s"), "target").select("point_id", "target", "run_id", "s", "dist")


def gap_still_free(targets: DataFrame, gaps: DataFrame, states: DataFrame) -> DataFrame:
    """``(target ids, still_free)``: the target's position is inside a published gap; a run without gaps
    is judged by its free count and an unknown run is left standing."""
    t = targets.select("point_id", "run_id", "s")
    held = t.withColumn("__e", F.col("s"))
    hit = (intervals.interval_pairs(held, gaps.filter("spaces > 0").select("run_id", "s0", "s1"), ["run_id"], ("s", "__e"), ("s0", "s1"))
           .select("point_id").distinct().withColumn("__in", F.lit(True)))
    has = gaps.select("run_id").distinct().withColumn("__has", F.lit(True))
    j = t.join(states.select("run_id", "free").withColumn("__known", F.lit(True)), "run_id", "left").join(has, "run_id", "left").join(hit, "point_id", "left")
    ok = (F.when(F.col("__known").isNull(), True).when(F.col("__has").isNull(), F.coalesce("free", F.lit(0)) > 0)
          .otherwise(F.coalesce("__in", F.lit(False))))
    return j.select("point_id", "run_id", ok.alias("still_free"))


def run_layer_report(runs: DataFrame, votes: DataFrame, dets_on_run: DataFrame, min_fraction: float = 0.05) -> DataFrame:
    """Kerbs a flight really looked at: free places, occupied metres, detections seen and outvoted ones."""
    length = runs.select("run_id", "length_m")
    cells = cut(votes.join(length, "run_id"))
    occ = intervals.runs_of_true(cells.filter("is_occupied"), ["run_id"], length="length_m")
    obs = intervals.runs_of_true(cells.filter("is_observed"), ["run_id"], length="length_m")
    seen = runs.join(obs.select("run_id").distinct(), "run_id", "left_semi")
    per, _ = intervals.free_gaps(seen, occ, obs)
    n = dets_on_run.groupBy("run_id").agg(F.count(F.lit(1)).alias("dets_seen"))
    j = per.filter(F.col("observed_fraction") > min_fraction).join(n, "run_id", "left").withColumn("dets_seen", F.coalesce("dets_seen", F.lit(0)).cast("bigint"))
    return j.select("run_id", "capacity", "free", "occupied_len_m", "dets_seen", "observed_fraction",
                    ((F.col("dets_seen") > 0) & (F.col("occupied_len_m") == 0)).alias("outvoted"))


def layer_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("capacity"), F.lit(0)).cast("bigint").alias("capacity"),
                      F.coalesce(F.sum("free"), F.lit(0)).cast("bigint").alias("free"), F.coalesce(F.sum("dets_seen"), F.lit(0)).cast("bigint").alias("dets_seen"),
                      F.coalesce(F.sum(F.col("outvoted").cast("int")), F.lit(0)).cast("bigint").alias("outvoted"))


