"""Flights: poses, headings, logs and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo
from ..functions.numeric import count_if, ratio, wrap_angle
from ..session import cut
from .scan import chunk_of, ordered_scan
from .spatial import off_route


def track_motion(poses: DataFrame, by: list[str], order: str = "idx", chunk: int = 4096, t: str | None = None) -> DataFrame:
    """Step length, course and (with a time column) speed towards the previous pose of the flight."""
    lag = {"px": "x", "py": "y", **({"pt": t} if t else {})}
    w = ordered_scan(poses, by, [order], chunk_of(order, chunk), lag=lag)
    step = geo.distance("px", "py", "x", "y")
    out = {"step_m": step, "course": F.when(step > 0, F.atan2(F.col("y") - F.col("py"), F.col("x") - F.col("px")))}
    if t:
        from ..functions.numeric import seconds_between

        out["speed"] = step / F.nullif(seconds_between(t, "pt"), F.lit(0.0))
    return w.withColumns(out).drop(*lag)


def track_summary(motion: DataFrame, by: list[str]) -> DataFrame:
    return motion.groupBy(*by).agg(F.count(F.lit(1)).alias("poses"), F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("length_m"), F.avg("step_m").alias("spacing_m"))


# Shortest move, weakest match, allowed ground-scale error, smoothing window.
MIN_MOVE_M, MIN_SCORE, GSD_TOL, SMOOTH = 3.0, 0.30, 0.25, 5


def heading_from_shift(pairs: DataFrame, min_move: float = MIN_MOVE_M, min_score: float = MIN_SCORE) -> DataFrame:
    """Heading and metres per pixel from how far the drone moved and the picture shifted.

    ``pairs``: ``flight, idx, dx, dy, du, dv, score``.  Short moves, weak matches and still pictures drop out.
    """
    move, px = F.hypot("dx", "dy"), F.hypot("du", "dv")
    yaw = F.pmod(F.atan2("dy", "dx") + F.atan2(-F.col("du"), F.col("dv")), F.lit(6.283185307179586))
    ok = (move >= min_move) & (F.col("score") >= min_score) & (px > 0)
    return pairs.filter(ok).withColumns({"yaw": yaw, "gsd": move / px, "course": F.atan2("dy", "dx")})


def gsd_gate(headings: DataFrame, expected_gsd: float | Column, tol: float = GSD_TOL) -> DataFrame:
    """Keep pairs whose ground scale agrees with the camera."""
    exp = F.lit(expected_gsd) if isinstance(expected_gsd, float) else expected_gsd
    return headings.filter(F.abs(F.col("gsd") / exp - 1) <= tol)


def circ_median(rows: DataFrame, by: list[str], angle: str, weight: str | None = None) -> DataFrame:
    """Per group the member angle with the least total wrapped distance to all members; ties to the least angle.

    Groups are counted by angle first (each row as often as ``weight`` says); a group must be a bounded window (here: neighbours in a track).
    """
    n = rows.groupBy(*by, angle).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    packed = n.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(angle).alias("a"), "n"))).alias("v"))
    cost = F.transform("v", lambda c: F.struct(
        F.round(F.aggregate("v", F.lit(0.0), lambda s, e: s + F.abs(wrap_angle(e.a - c.a)) * e.n), 6).alias("cost"), c.a.alias("a")))
    return packed.select(*by, F.array_min(cost).a.alias("yaw"))


def course_median(good: DataFrame, bins: int = 3600) -> DataFrame:
    """One angle per flight from its courses, in steps of a tenth of a degree.

    The candidate set is the fixed circle of ``bins`` steps, so a long flight never meets itself.
    """
    width = 6.283185307179586 / bins
    b = F.pmod(F.bround(F.col("course") / width), F.lit(float(bins))).cast("int")
    hist = good.groupBy("flight", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return circ_median(hist.select("flight", (F.col("bin") * width).alias("a"), "n").withColumn("a", wrap_angle("a")).select("flight", "a", "n"), ["flight"], "a", "n")


def smooth_heading(poses: DataFrame, good: DataFrame, smooth: int = SMOOTH, chunk: int = 4096) -> DataFrame:
    """``(flight, idx, yaw, yaw_src)``: circular median of the good headings within ``smooth`` poses,
    else the flight's middle course.

    Poses and headings lie in chunks of the flight, headings near an end in both; a window brings a pose the few around it.
    """
    g = good.filter("flight is not null").select("flight", "idx", F.col("yaw").alias("__a"))
    over = F.sequence(chunk_of(F.col("idx") - smooth, chunk), chunk_of(F.col("idx") + smooth, chunk))
    rows = g.select("flight", F.explode(over).alias("__chunk"), "idx", "__a", F.lit(False).alias("__pose"))
    mine = poses.select("flight", chunk_of("idx", chunk).alias("__chunk"), "idx", F.lit(None).cast(g.schema["__a"].dataType).alias("__a"), F.lit(True).alias("__pose"))
    around = Window.partitionBy("flight", "__chunk").orderBy("idx").rangeBetween(-smooth, smooth)
    seen = mine.unionByName(rows).withColumn("__v", F.collect_list("__a").over(around)).filter("__pose")
    v = F.array_sort("__v")
    cost = geo.let(v, lambda w: F.transform(w, lambda c: F.struct(
        F.round(geo.fold(w, lambda e: F.abs(wrap_angle(e - c))), 6).alias("cost"), c.alias("a"))))
    whole = course_median(good).withColumnRenamed("yaw", "__course")
    out = seen.select("flight", "idx", F.array_min(cost).a.alias("__flow")).join(whole, "flight", "left")
    src = F.when(F.col("__flow").isNotNull(), "flow").when(F.col("__course").isNotNull(), "course")
    return out.select("flight", "idx", F.round(F.coalesce("__flow", "__course"), 6).alias("yaw"), src.alias("yaw_src"))


# Speeds in m/s, turn angles in radians, braking in m/s2.
V_MAX, V_TURN, V_REV = 5.0, 2.0, 0.8
TURN_FREE, TURN_HARD, REV_HARD = 0.3, 1.2, 2.6
BRAKE = 0.22


def speed_profile(route: DataFrame, by: list[str], order: str = "idx", chunk: int = 4096) -> DataFrame:
    """Speed limit per waypoint: corner limit, lowered so that braking ahead of slower points is in time.

    With ``D`` the distance from the start, braking means ``v_i^2 + 2aD_i <= v_j^2 + 2aD_j`` for all later
    ``j``, so the limit is a running minimum from the end.
    """
    pos = ordered_scan(route, by, [order], chunk_of(order, chunk), lag={"px": "x", "py": "y"}, lead={"nx": "x", "ny": "y"})
    x0, y0 = F.coalesce("px", F.lit(0.0)), F.coalesce("py", F.lit(0.0))
    turn = F.abs(wrap_angle(F.atan2(F.col("ny") - F.col("y"), F.col("nx") - F.col("x")) - F.atan2(F.col("y") - y0, F.col("x") - x0)))

    def part(lo, hi):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (turn - lo) / (hi - lo)))

    corner = F.when(turn <= TURN_HARD, V_MAX - part(TURN_FREE, TURN_HARD) * (V_MAX - V_TURN)).otherwise(V_TURN - part(TURN_HARD, REV_HARD) * (V_TURN - V_REV))
    flat = F.col("nx").isNull() | ((x0 == F.col("x")) & (y0 == F.col("y")))
    pos = pos.withColumns({"corner": F.when(flat, F.lit(V_TURN)).otherwise(corner), "__step": F.coalesce(F.when(F.col("px").isNotNull(), geo.distance("px", "py", "x", "y")), F.lit(0.0))})
    pos = cut(pos)
    far = cut(ordered_scan(pos, by, [order], chunk_of(order, chunk), running_sum={"__d": F.col("__step")}))
    energy = F.col("corner") * F.col("corner") + 2 * BRAKE * F.col("__d")
    back = ordered_scan(far, by, [order], chunk_of(order, chunk), later_min={"__later": energy})
    v = F.sqrt(F.greatest(F.lit(0.0), F.least(energy, F.coalesce("__later", energy)) - 2 * BRAKE * F.col("__d")))
    return back.withColumn("speed", v).select(*by, order, "corner", "speed")


# ---- logs --------------------------------------------------------------------

def episodes(log: DataFrame, by: list[str], flag: str, order: str = "idx", chunk: int = 4096, crawl: float = 1.0) -> DataFrame:
    """Stretches of flagged rows: start, end, mean speed, net distance, side and whether it crawled."""
    on = F.coalesce(F.col(flag), F.lit(False))
    prev = ordered_scan(log.withColumn("__on", on), by, [order], chunk_of(order, chunk), lag={"__was": "__on"})
    start = F.col("__on") & ~F.coalesce("__was", F.lit(False))
    num = ordered_scan(prev, by, [order], chunk_of(order, chunk), running_sum={"episode": start.cast("bigint")})
    first, last = F.min_by(F.struct("t", "x", "y", "side"), order), F.max_by(F.struct("t", "x", "y"), order)
    e = num.filter("__on").groupBy(*by, "episode").agg(first.alias("a"), last.alias("b"), F.avg("speed").alias("mean_speed"), F.count(F.lit(1)).alias("rows"))
    return e.select(*by, "episode", F.col("a.t").alias("t0"), F.col("b.t").alias("t1"), "rows", "mean_speed", geo.distance("a.x", "a.y", "b.x", "b.y").alias("net_m"),
                    F.when(F.col("a.side") == 1, "left").otherwise("right").alias("side"), (F.col("mean_speed") < crawl).alias("crawled"))


MANUAL_MODES = ("STABILIZE", "ACRO")


def mode_timeline(log: DataFrame, by: list[str], order: str = "idx", chunk: int = 4096) -> DataFrame:
    """Mode changes only, with a mark for modes flown by hand."""
    prev = ordered_scan(log, by, [order], chunk_of(order, chunk), lag={"__was": "mode"})
    return prev.filter(~F.col("__was").eqNullSafe(F.col("mode"))).drop("__was").withColumn("manual", F.col("mode").isin(*MANUAL_MODES))


def flight_health(messages: DataFrame, by: list[str]) -> DataFrame:
    """Extremes of a long message table ``kind, field, value`` with the warnings they raise."""
    def of(kind, field):
        return F.when((F.col("kind") == kind) & (F.col("field") == field), F.col("value"))

    m = messages.groupBy(*by).agg(
        F.min(of("GPS", "NSats")).alias("min_sats"), F.max(of("GPS", "HDop")).alias("max_hdop"), F.max(of("GPS", "Status")).alias("best_fix"),
        F.greatest(*[F.coalesce(F.max(of("VIBE", f"Vibe{a}")), F.lit(0.0)) for a in "XYZ"]).alias("max_vibe"),
        F.greatest(*[F.coalesce(F.max(of("VIBE", f"Clip{i}")), F.lit(0.0)) for i in range(3)]).alias("max_clip"),
        F.max(of("ATT", "RollErr")).alias("max_roll_err"), F.max(of("ATT", "PitchErr")).alias("max_pitch_err"),
        F.min(of("BAT", "Volt")).alias("min_volt"), count_if(F.col("kind") == "ERR").alias("errors"))
    warn = F.array_compact(F.array(
        F.when(F.coalesce("best_fix", F.lit(0.0)) < 3, "no 3d fix"), F.when(F.col("max_hdop") > 2.0, "hdop"),
        F.when((F.col("max_vibe") > 30) | (F.col("max_clip") > 0), "vibration"),
        F.when(F.greatest("max_roll_err", "max_pitch_err") >= 5, "attitude")))
    return m.withColumn("warnings", F.array_join(warn, ","))


def coverage_declaration(waypoints: DataFrame, poses: DataFrame, skipped: DataFrame) -> DataFrame:
    """What a flight saw of the waypoints up to the last one reached, per flight.

    Skipped waypoints with a standoff shot are recovered; the others stay uncovered.
    """
    reached = poses.groupBy("flight").agg(F.max("frame_idx").alias("reached"), F.count_distinct("frame_idx").alias("captured"))
    shot = poses.filter("standoff").select("flight", F.col("frame_idx").alias("wp")).distinct().withColumn("__back", F.lit(True))
    s = skipped.select("flight", "wp").distinct().join(shot, ["flight", "wp"], "left").groupBy("flight").agg(
        F.count(F.lit(1)).alias("unreachable"), count_if(F.col("__back")).alias("recovered"), count_if(F.col("__back").isNull()).alias("uncovered"))
    w = waypoints.groupBy("flight").agg(F.count(F.lit(1)).alias("waypoints"))
    j = w.join(reached, "flight", "left").join(s, "flight", "left").na.fill(0, ["captured", "unreachable", "recovered", "uncovered"])
    return j.withColumn("covered_pct", F.round(100 * ratio("captured", F.col("reached") + 1), 1))


STANDOFF_M = 11.0


def excursion_report(log: DataFrame, route: DataFrame, every: int = 5, standoff_m: float = STANDOFF_M) -> DataFrame:
    """Closest obstacle return and how far the flight left its route (every ``every``-th row, as logged)."""
    from .serve import side_by_side

    clear = log.agg(F.min("obst_m").alias("closest_m")).withColumn("below_standoff", F.col("closest_m") < standoff_m)
    some = log.filter(F.pmod(F.col("idx"), F.lit(every)) == 0).select("idx", "x", "y", "steering")
    off = cut(off_route(some, route, "idx", "x", "y").join(some.select("idx", "steering"), "idx"))
    steer = F.when(F.col("steering"), F.col("dist"))
    return side_by_side(clear, off.agg(F.max("dist").alias("max_off_m"), F.coalesce(F.max(steer), F.lit(0.0)).alias("steer_max_m"), F.coalesce(F.avg(steer), F.lit(0.0)).alias("steer_mean_m")))
