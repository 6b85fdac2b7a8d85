"""Published answers: map rows, closures, zone and fleet reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import as_time, col, count_if, ratio, seconds_between, within_window
from .scan import latest_per_key
from .stats import percentiles
from .spatial import points_in_areas

BAY_WINDOW_S = 7200


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Columns of several one-row tables in one row, by a union and one aggregate instead of joins."""
    types = [r.schema for r in rows]
    parts = [r.select(*[(F.struct(*r.columns) if j == i else F.lit(None).cast(t)).alias(f"p{j}") for j, t in enumerate(types)])
             for i, r in enumerate(rows)]
    whole = reduce(DataFrame.unionByName, parts).agg(*[F.first(f"p{j}", ignorenulls=True).alias(f"p{j}") for j in range(len(rows))])
    return whole.select(*[F.col(f"p{j}.{c}") for j, t in enumerate(types) for c in t.names])


def is_fresh(updated_at, as_of, window_s: float = BAY_WINDOW_S) -> Column:
    return within_window(updated_at, as_of, window_s)


def is_active(valid_from, valid_to, as_of) -> Column:
    """Half-open validity; a missing bound is open."""
    now = as_time(as_of)
    return (col(valid_from).isNull() | (col(valid_from) <= now)) & (col(valid_to).isNull() | (col(valid_to) > now))


def bay_status(closed, occupied, updated_at, as_of, window_s: float = BAY_WINDOW_S) -> Column:
    """``closed`` beats ``unknown`` beats ``occupied``/``free``."""
    known = F.coalesce(is_fresh(updated_at, as_of, window_s), F.lit(False)) & col(occupied).isNotNull()
    return (F.when(F.coalesce(col(closed), F.lit(False)), "closed").when(~known, "unknown")
            .when(col(occupied), "occupied").otherwise("free"))


def bbox_filter(df: DataFrame, bbox: tuple | None = None, zona: str | None = None,
                cols: tuple = ("min_x", "min_y", "max_x", "max_y")) -> DataFrame:
    """Rows whose envelope touches the box; plain comparisons, so they reach the scan."""
    if bbox is not None:
        x0, y0, x1, y1 = bbox
        df = df.filter((F.col(cols[0]) <= x1) & (F.col(cols[2]) >= x0) & (F.col(cols[1]) <= y1) & (F.col(cols[3]) >= y0))
    if zona is not None:
        df = df.filter(F.col("zona") == zona)
    return df


def cut_block(df: DataFrame, lon: str, lat: str, center: tuple, half_m: float) -> DataFrame:
    """Square block around ``(lon, lat)``, half a side in metres, edges included."""
    import math

    dlat = half_m / 111320.0
    dlon = half_m / (111320.0 * math.cos(math.radians(center[1])))
    return df.filter(F.col(lon).between(center[0] - dlon, center[0] + dlon) & F.col(lat).between(center[1] - dlat, center[1] + dlat))


def closed_bays(bays: DataFrame, closures: DataFrame, as_of) -> DataFrame:
    """``(bay_id, closure_id, valid_from, valid_to)`` of bays under an active closure, by position.

    Overlaps resolve to the earliest start (open start first), then the least id.
    """
    hit = points_in_areas(bays.select("bay_id", "x", "y"), closures.filter(is_active("valid_from", "valid_to", as_of)), "x", "y")
    rank = F.struct(F.col("valid_from").isNotNull(), F.col("valid_from"), F.col("closure_id"))
    best = hit.groupBy("bay_id").agg(F.min_by(F.struct("closure_id", "valid_from", "valid_to"), rank).alias("c"))
    return best.select("bay_id", "c.*")


def bays_in_closure(bays: DataFrame, closures: DataFrame, closure_id: str) -> DataFrame:
    return points_in_areas(bays.select("bay_id", "x", "y"), closures.filter(F.col("closure_id") == closure_id), "x", "y").select("bay_id")


def closures_with_counts(bays: DataFrame, closures: DataFrame, as_of, active_only: bool = True) -> DataFrame:
    if active_only:
        closures = closures.filter(is_active("valid_from", "valid_to", as_of))
    n = points_in_areas(bays.select("bay_id", "x", "y"), closures, "x", "y").groupBy("closure_id").agg(F.count(F.lit(1)).alias("bays"))
    return closures.join(n, "closure_id", "left").withColumn("bays", F.coalesce("bays", F.lit(0)).cast("bigint"))


def bays_with_state(bays: DataFrame, state: DataFrame, closures: DataFrame, as_of, window_s: float = BAY_WINDOW_S) -> DataFrame:
    """Map rows: verdict columns only while fresh, closure columns regardless of age."""
    gated = ("occupied", "confidence", "backend")
    fresh = is_fresh("updated_at", as_of, window_s)
    joined = bays.join(state, "bay_id", "left").withColumns({c: F.when(fresh, F.col(c)) for c in gated})
    shut = closed_bays(bays, closures, as_of).select("bay_id", "closure_id", F.col("valid_to").alias("closure_until"))
    return joined.join(shut, "bay_id", "left").withColumn("closed", F.col("closure_id").isNotNull())


def _verdict_counts() -> list[Column]:
    open_ = ~F.col("closed")
    return [
        count_if(open_ & (F.col("occupied") == False)).alias("free"),  # noqa: E712
        count_if(open_ & F.col("occupied")).alias("occupied"),
        count_if(open_ & F.col("occupied").isNull()).alias("unknown"),
        count_if(F.col("closed")).alias("closed"),
    ]


def zone_summary(map_rows: DataFrame, by: str = "zona") -> DataFrame:
    """Counts per zone over ``bays_with_state`` rows; closed bays count only as closed."""
    return map_rows.groupBy(by).agg(*_verdict_counts())


def coverage_counts(map_rows: DataFrame) -> DataFrame:
    """Totals; unknown is what is left over; shares of at least one bay."""
    out = map_rows.agg(F.count(F.lit(1)).alias("bays_total"), *_verdict_counts())
    out = out.withColumn("unknown", F.col("bays_total") - F.col("occupied") - F.col("free") - F.col("closed"))
    den = F.greatest(F.lit(1), F.col("bays_total"))
    return out.select("bays_total", *[F.col(c).alias(f"bays_{c}") for c in ("occupied", "free", "closed", "unknown")],
                      *[(F.col(c) / den).alias(f"{c}_share") for c in ("occupied", "free", "closed", "unknown")])


# ---- pipeline health -------------------------------------------------------

def job_counts(jobs: DataFrame, as_of) -> DataFrame:
    now = as_time(as_of)
    states = ("queued", "running", "processed", "failed")
    return jobs.agg(
        *[count_if(F.col("status") == s).alias(s) for s in states],
        F.round(seconds_between(now, F.min(F.when(F.col("status") == "queued", F.col("enqueued_at")))), 1).alias("oldest_queued_age_s"),
        count_if((F.col("status") == "running") & (F.col("lease_expires_at") < now)).alias("expired_leases"))


def unassigned_counts(jobs: DataFrame, as_of, window_s: float) -> DataFrame:
    """Frames that measured discarded detections; frames that did not measure are left out."""
    seen = jobs.filter(F.col("unassigned_dets").isNotNull() & within_window("finished_at", as_of, window_s))
    out = seen.agg(F.count(F.lit(1)).alias("frames_measured"), F.coalesce(F.sum("unassigned_dets"), F.lit(0)).alias("unassigned"),
                   F.coalesce(F.sum("unassigned_near"), F.lit(0)).alias("unassigned_near"))
    return out.withColumn("unassigned_per_frame", F.round(ratio("unassigned", "frames_measured"), 2))


def ingest_rates(frames: DataFrame, as_of, window_s: float) -> DataFrame:
    def n(secs):
        return count_if(within_window("received_at", as_of, secs))

    return frames.agg(
        n(60).alias("frames_last_1m"), n(3600).alias("frames_last_1h"), n(window_s).alias("frames_in_window"),
        F.round(n(window_s) * 60.0 / F.lit(float(window_s)), 2).alias("frames_per_min_window"), F.max("received_at").alias("last_frame_at"))


def classify_latency(jobs: DataFrame, as_of, window_s: float) -> DataFrame:
    done = jobs.filter(within_window("finished_at", as_of, window_s)).select("status", seconds_between("finished_at", "enqueued_at").alias("took"))
    failed = count_if(F.col("status") == "failed")
    counts = done.agg(
        F.count(F.lit(1)).alias("finished_in_window"), F.round(F.avg("took"), 3).alias("avg_s"),
        failed.alias("failed_in_window"), F.round(ratio(failed, F.count(F.lit(1))), 4).alias("failure_rate"))
    ranks = percentiles(done, [], "took", {"p50_s": (0.5, "continuous"), "p95_s": (0.95, "continuous")})
    return side_by_side(counts, ranks.select(F.round("p50_s", 3).alias("p50_s"), F.round("p95_s", 3).alias("p95_s")))


def drone_activity(drones: DataFrame, as_of, window_s: float) -> DataFrame:
    return drones.agg(F.count(F.lit(1)).alias("drones_total"), count_if(within_window("last_seen", as_of, window_s)).alias("drones_active"))


def open_missions(missions: DataFrame, frames: DataFrame, as_of, top: int = 20) -> DataFrame:
    """Newest unfinished missions with the seconds since their last frame."""
    last = frames.filter("mission_id is not null").groupBy("mission_id").agg(F.max("received_at").alias("__last"))
    live = missions.filter(F.col("ended_at").isNull()).join(last, "mission_id", "left")
    return (live.withColumn("since_last_frame_s", F.round(seconds_between(as_time(as_of), "__last"), 1)).drop("__last")
            .orderBy(F.col("started_at").desc(), F.col("mission_id")).limit(top))


def fleet_health(drones: DataFrame, missions: DataFrame, frames: DataFrame, as_of, window_s: float, top: int = 20) -> DataFrame:
    """One row: drone counts and the open missions as an array of at most ``top``."""
    listed = open_missions(missions, frames, as_of, top)
    packed = listed.agg(F.count(F.lit(1)).alias("missions_active"), F.collect_list(F.struct(*listed.columns)).alias("missions"))
    return side_by_side(drone_activity(drones, as_of, window_s), packed)


def model_accuracy(obs: DataFrame, state: DataFrame) -> DataFrame:
    """Labelled looks and labelled bays that came out right; NULL, not 0, without labels."""
    labelled = obs.filter("gt is not null")
    views = labelled.agg(F.count(F.lit(1)).alias("views_scored"), count_if(F.col("occupied") == F.col("gt")).alias("views_correct"))
    label = latest_per_key(labelled.select("bay_id", "gt", "observed_at", "event_id"), ["bay_id"], F.struct("observed_at", "event_id"))
    bays = label.join(state.select("bay_id", F.col("occupied").alias("verdict")), "bay_id").agg(
        F.count(F.lit(1)).alias("bays_scored"), count_if(F.col("verdict") == F.col("gt")).alias("bays_correct"))
    return side_by_side(views, bays).withColumns({
        "view_accuracy": F.round(ratio("views_correct", "views_scored"), 4),
        "state_accuracy": F.round(ratio("bays_correct", "bays_scored"), 4)})


def run_totals(runs: DataFrame, state: DataFrame, as_of, window_s: float = BAY_WINDOW_S, every_run: bool = False) -> DataFrame:
    """Fresh cars, free places and observed capacity; capacity itself is not gated.

    ``every_run`` counts runs without a state too (the map), else only runs with one.
    """
    joined = runs.select("run_id", "capacity").join(state, "run_id", "left" if every_run else "inner")
    fresh = is_fresh("updated_at", as_of, window_s)
    return joined.agg(
        F.count(F.lit(1)).alias("runs"),
        *[F.coalesce(F.sum(F.when(fresh, F.col(c))), F.lit(0)).cast("bigint").alias(c) for c in ("cars", "free", "capacity_observed")],
        F.coalesce(F.sum("capacity"), F.lit(0)).cast("bigint").alias("capacity_total"))


def metrics_snapshot(**parts: DataFrame) -> DataFrame:
    """Single-row reports gathered as one row of structs."""
    rows = [df.select(F.struct(*df.columns).alias(name)) for name, df in parts.items()]
    return side_by_side(*rows)


def long_metrics(single_row: DataFrame, prefix: str, cols: list[str]) -> DataFrame:
    """``(name, value)`` pairs of a one-row report."""
    pairs = F.array(*[F.struct(F.lit(f"{prefix}_{c}").alias("name"), F.col(c).cast("double").alias("value")) for c in cols])
    return single_row.select(F.explode(pairs).alias("m")).select("m.name", "m.value")


def prometheus_lines(metrics: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """HELP, TYPE and value lines; a NULL series is absent rather than zero.

    ``metrics`` has ``name, value`` and optionally ``kind, help``.
    """
    m = metrics
    for c, default in (("kind", "gauge"), ("help", "")):
        if c not in m.columns:
            m = m.withColumn(c, F.lit(default))
    m = m.filter("value is not null")
    lines = F.array(
        F.concat(F.lit("# HELP "), "name", F.lit(" "), "help"),
        F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind"),
        F.concat("name", F.lit(" "), F.col("value").cast("string")))
    return m.select("name", F.posexplode(lines).alias("part", "line"))


# ---- live views ------------------------------------------------------------

def ingest_series(frames: DataFrame, width: str = "1 minute", slide: str | None = None, last: int | None = 180) -> DataFrame:
    """Frames per window; the newest ``last`` windows for a chart, all with ``last=None``."""
    win = F.window("received_at", width, slide) if slide else F.window("received_at", width)
    out = frames.groupBy(win.alias("w")).agg(F.count(F.lit(1)).alias("frames"))
    out = out.select(F.col("w.start").alias("started"), "frames")
    return out.orderBy(F.col("started").desc()).limit(last) if last else out


def flight_sessions(rows: DataFrame, ts: str, by: list[str], gap: str = "10 minutes") -> DataFrame:
    """Activity sessions that end after ``gap`` without a row."""
    s = rows.groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("frames"), F.max(ts).alias("last_at"))
    return s.select(*by, F.col("w.start").alias("started"), "last_at", "frames")


def liveness(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Last sign of life per drone and frames done per mission."""
    seen = frames.groupBy("drone_id").agg(F.max("received_at").alias("last_seen"))
    done = frames.filter("mission_id is not null").groupBy("mission_id").agg(F.count(F.lit(1)).alias("frames_done"), F.max("received_at").alias("last_frame_at"))
    return seen, done


def closure_deltas(bays: DataFrame, state: DataFrame, before: DataFrame, after: DataFrame, as_of, window_s: float = BAY_WINDOW_S) -> DataFrame:
    """State announcements for bays of every closure that was added, changed, ended or removed."""
    cols = ["closure_id", "ring", "valid_from", "valid_to"]
    a, b = before.select(*cols), after.select(*cols)
    same = (F.col("a.ring") == F.col("b.ring")) & F.col("a.valid_from").eqNullSafe(F.col("b.valid_from")) & F.col("a.valid_to").eqNullSafe(F.col("b.valid_to"))
    moved = (a.alias("a").join(b.alias("b"), "closure_id", "full_outer").filter(~F.coalesce(same, F.lit(False))).select("closure_id"))
    touched_shapes = a.join(moved, "closure_id").unionByName(b.join(moved, "closure_id"))
    touched = points_in_areas(bays.select("bay_id", "x", "y"), touched_shapes, "x", "y").select("bay_id").distinct()
    rows = bays_with_state(bays.join(touched, "bay_id"), state, after, as_of, window_s)
    return rows.select("bay_id", "occupied", "confidence", "updated_at", "closed")


def run_map_rows(runs: DataFrame, state: DataFrame, as_of, window_s: float = BAY_WINDOW_S) -> DataFrame:
    """Verified kerbs with their state while fresh."""
    fresh = is_fresh("updated_at", as_of, window_s)
    gated = [c for c in ("cars", "free", "capacity_observed", "observed_fraction", "backend", "gaps") if c in state.columns]
    return runs.filter("verified").join(state, "run_id", "left").withColumns({c: F.when(fresh, F.col(c)) for c in gated})


