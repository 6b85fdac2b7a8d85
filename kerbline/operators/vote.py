"""Evidence to state: idempotent appends, the windowed vote, changes and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import as_time, count_if, minus_seconds, within_window
from .scan import latest_per_key, top_per_key

BAY_WINDOW_S = 7200


def newest_mission(evidence: DataFrame, key: str, as_of, window_s: float, aggs: list[Column], tie: str = "event_id") -> DataFrame:
    """Aggregate evidence of the mission that looked at each key last, inside the window.

    Two partial-aggregated groupings and no join: totals per (key, mission), then the mission
    with the newest row.  Rows without a mission form one group of their own.
    """
    fresh = evidence.filter(within_window("observed_at", as_of, window_s))
    per = fresh.groupBy(key, "mission_id").agg(F.max(F.struct("observed_at", tie)).alias("__last"), *aggs)
    whole = F.struct(*[F.col(c) for c in per.columns])
    return per.groupBy(key).agg(F.max_by(whole, F.col("__last")).alias("r")).select("r.*").drop("__last")


def vote_states(obs: DataFrame, as_of, window_s: float = BAY_WINDOW_S, area: str | None = None) -> DataFrame:
    """One row per bay: strict majority of the newest mission's looks inside the window."""
    if area is not None:
        obs = obs.filter(F.col("survey_area") == area)
    voted = newest_mission(obs, "bay_id", as_of, window_s, [
        F.count(F.lit(1)).alias("n"), count_if(F.col("occupied")).alias("occ"), F.max("backend").alias("backend")])
    return voted.select(
        "bay_id", "mission_id", "n", "occ", (F.col("occ") * 2 > F.col("n")).alias("occupied"),
        (F.greatest(F.col("occ"), F.col("n") - F.col("occ")) / F.col("n")).alias("confidence"), "backend")


def state_changes(prior: DataFrame, voted: DataFrame) -> DataFrame:
    """Bays whose verdict is new or flipped, with confidence to three places."""
    old = prior.select("bay_id", F.col("occupied").alias("__was"), F.lit(True).alias("__known"))
    joined = voted.join(old, "bay_id", "left")
    changed = F.col("__known").isNull() | ~F.col("__was").eqNullSafe(F.col("occupied"))
    return joined.filter(changed).select("bay_id", "occupied", F.round("confidence", 3).alias("confidence"))


def vote_views(views: DataFrame) -> DataFrame:
    """Per bay over all frames: verdict, look count and occupied looks."""
    out = views.groupBy("bay_id").agg(F.count(F.lit(1)).alias("views"), count_if(F.col("occupied")).alias("n_occ"))
    return out.select("bay_id", (F.col("n_occ") * 2 > F.col("views")).alias("occupied"), "views", "n_occ")


def views_overview(voted: DataFrame) -> DataFrame:
    """How often bays were seen: bays with one look, least, upper median and most looks."""
    # one row per distinct look count, so the median needs no list of all bays
    hist = voted.groupBy("views").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("occupied")).alias("occ"))
    found = (hist.agg(F.array_sort(F.collect_list(F.struct("views", "n", "occ"))).alias("h"))
             .withColumn("total", F.aggregate("h", F.lit(0).cast("bigint"), lambda a, e: a + e.n)))

    # walk the histogram until the middle bay is reached
    mid = F.aggregate(
        "h", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("at")),
        lambda a, e: F.struct((a.seen + e.n).alias("seen"),
                              F.when(a.at.isNull() & (a.seen + e.n > F.floor(F.col("total") / 2)), e.views).otherwise(a.at).alias("at")))
    return found.select(
        F.col("total").alias("bays"),
        F.aggregate("h", F.lit(0).cast("bigint"), lambda a, e: a + e.occ).alias("occupied"),
        F.aggregate("h", F.lit(0).cast("bigint"), lambda a, e: a + F.when(e.views == 1, e.n).otherwise(F.lit(0).cast("bigint"))).alias("single_view"),
        F.get("h", F.lit(0)).views.alias("views_min"), mid["at"].alias("views_median"),
        F.get("h", F.size("h") - 1).views.alias("views_max"))


def vote_with_best_view(views: DataFrame, features: list[str]) -> DataFrame:
    """Vote plus the features of the fullest view nearest the image centre."""
    best = F.struct(F.col("frame_idx"), *[F.col(c) for c in features])
    out = views.groupBy("bay_id").agg(
        F.count(F.lit(1)).alias("views"), count_if(F.col("occupied")).alias("n_occ"),
        F.min_by(best, F.struct(-F.col("vis"), F.col("off"), F.col("frame_idx"))).alias("b"))
    return out.select("bay_id", (F.col("n_occ") * 2 > F.col("views")).alias("occupied"), "views", "n_occ", "b.*")


def uncovered(bays: DataFrame, seen: DataFrame) -> DataFrame:
    """Bays no usable view exists for."""
    return bays.join(seen.select("bay_id").distinct(), "bay_id", "left_anti")


# ---- tables ----------------------------------------------------------------

def upsert(target: DataFrame, updates: DataFrame, keys: list[str], monotonic: str | None = None) -> DataFrame:
    """Replace rows by key; with ``monotonic`` only a strictly newer update wins."""
    tagged = target.withColumn("__src", F.lit(0)).unionByName(updates.withColumn("__src", F.lit(1)))
    order = F.struct(*([F.col(monotonic), -F.col("__src")] if monotonic else [F.col("__src")]))
    return latest_per_key(tagged, keys, order).drop("__src")


def append_observations(existing: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    """Rows of ``new`` that are not yet stored under (frame, bay); rows without a frame all pass."""
    keys = ["frame_id", "bay_id"]
    keyed = latest_per_key(new.filter("frame_id is not null"), keys, order, newest=False)
    stored = existing.filter("frame_id is not null").select(*keys)
    return keyed.join(stored, keys, "left_anti").select(*new.columns).unionByName(new.filter("frame_id is null"))


def frame_key() -> Column:
    return F.coalesce(F.col("mission_id"), F.concat(F.lit("area:"), F.col("survey_area")))


def ingest_frames(existing: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    """``(frame_id, stored_id, duplicate)`` per delivered frame; duplicates name the stored frame."""
    keys = ["drone_id", "__mission", "frame_idx"]
    new = new.withColumn("__mission", frame_key())
    held = existing.withColumn("__mission", frame_key()).groupBy(*keys).agg(F.min("frame_id").alias("__held"))
    first = new.groupBy(*keys).agg(F.min_by("frame_id", order).alias("__first"))
    plan = first.join(held, keys, "left").select(*keys, F.coalesce("__held", "__first").alias("stored_id"))
    return new.join(plan, keys).select("frame_id", "stored_id", (F.col("frame_id") != F.col("stored_id")).alias("duplicate"))


def new_jobs(ingested: DataFrame) -> DataFrame:
    """A queued job for every frame that was really new."""
    return ingested.filter(~F.col("duplicate")).select("frame_id", F.lit("queued").alias("status"))


def replace_frame_evidence(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence after re-scoring: rows of re-delivered frames go, rows without a frame only add."""
    frames = new.filter("frame_id is not null").select("frame_id").distinct()
    return existing.join(frames, "frame_id", "left_anti").unionByName(new)


def delete_area(tables: dict[str, DataFrame], area: str, area_of: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove an area from every table; ``(what stays, deleted counts per table)``.

    ``area_of`` maps a table to the column holding the area.  Tables without one are resolved
    through the bays (or runs) the area's observations name, before those go.
    """
    stays, counts = {}, None
    obs = tables["observation"].filter(F.col(area_of["observation"]) == area)
    bays = obs.select("bay_id").distinct()
    for name, df in tables.items():
        if name in area_of:
            hit = df.filter(F.col(area_of[name]) == area)
            keep = df.filter(~F.col(area_of[name]).eqNullSafe(F.lit(area)))
        else:
            hit, keep = df.join(bays, "bay_id", "left_semi"), df.join(bays, "bay_id", "left_anti")
        stays[name] = keep
        one = hit.agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table_name"), "deleted")
        counts = one if counts is None else counts.unionByName(one)
    return stays, counts


def area_census(tables: dict[str, DataFrame], area: str = "survey_area") -> DataFrame:
    """Rows per area in each table, zero where a table has none."""
    parts = None
    for name, df in tables.items():
        one = df.select(area, *[F.lit(1 if n == name else 0).alias(n) for n in tables])
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(area).agg(*[F.sum(n).cast("bigint").alias(n) for n in tables])


def backfill_mission(obs: DataFrame, frames: DataFrame) -> DataFrame:
    """Fill a missing mission where (area, frame number) belongs to exactly one."""
    keys = ["survey_area", "frame_idx"]
    only = (frames.filter("mission_id is not null").groupBy(*keys)
            .agg(F.min("mission_id").alias("__lo"), F.max("mission_id").alias("__hi"))
            .filter(F.col("__lo") == F.col("__hi")).select(*keys, F.col("__lo").alias("__only")))
    return obs.join(only, keys, "left").withColumn("mission_id", F.coalesce("mission_id", "__only")).drop("__only")


def bay_history(obs: DataFrame, limit: int = 20, bay_id: str | None = None) -> DataFrame:
    """Newest looks of one bay, or of every bay."""
    if bay_id is not None:
        obs = obs.filter(F.col("bay_id") == bay_id)
    order = [F.col("observed_at").desc(), F.col("event_id").desc()]
    return top_per_key(obs, ["bay_id"], order, limit, F.struct("event_id"))


# ---- change log ------------------------------------------------------------

def delta_log(deltas: DataFrame, order: list, base: int | Column = 0) -> DataFrame:
    """Numbered change log with the message that goes out, cursor included as text."""
    from .scan import global_number

    numbered = global_number(deltas, order, "cursor", base)
    msg = F.to_json(F.struct(F.lit("bay_delta").alias("type"), "bay_id", "occupied", "confidence", F.col("cursor").cast("string").alias("cursor")))
    return numbered.select("cursor", "bay_id", msg.alias("payload"))


def replay(log: DataFrame, since: int, slack: int = 50, limit: int = 500) -> DataFrame:
    """What a returning reader missed, starting a little behind its cursor, oldest first."""
    return log.filter(F.col("cursor") > max(since - slack, 0)).orderBy("cursor").limit(limit)


def head(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("cursor"), F.lit(0)).cast("bigint").alias("head"))


def merge_live(snapshot: DataFrame, deltas: DataFrame, order: str) -> DataFrame:
    """Lay the last change per bay over a snapshot; a live NULL verdict overrides too."""
    last = deltas.groupBy("bay_id").agg(F.max_by(F.struct("occupied", F.col("updated_at").alias("at")), F.col(order)).alias("__live"))
    joined = snapshot.join(last, "bay_id", "left")
    live = F.col("__live").isNotNull()
    return joined.withColumns({
        "occupied": F.when(live, F.col("__live.occupied")).otherwise(F.col("occupied")),
        "updated_at": F.when(live, F.col("__live.at")).otherwise(F.col("updated_at")),
    }).drop("__live")


def manual_override(states: DataFrame, orders: DataFrame) -> DataFrame:
    """Operator verdicts (``bay_id, occupied, at``) join the states; the later one stands."""
    manual = latest_per_key(orders, ["bay_id"], F.struct("at", "occupied")).select(
        "bay_id", "occupied", F.lit(1.0).alias("confidence"), F.lit("manual").alias("source"), F.col("at").alias("updated_at"))
    mine = states.select("bay_id", "occupied", "confidence", "source", "updated_at")
    return upsert(mine, manual, ["bay_id"], monotonic="updated_at")


def resolve_orders(orders: DataFrame, bays: DataFrame, x: float, y: float) -> tuple[DataFrame, DataFrame]:
    """``(accepted, refused)`` operator orders: one without a bay means the bay closest to ``(x, y)``; one that names
    an unknown bay is refused, and so is one without a bay where there is none to fall back on."""
    from .spatial import nearest

    spark = orders.sparkSession
    centre = spark.createDataFrame([(0, float(x), float(y))], "p int, x double, y double")
    closest = nearest(centre, bays, "p", "bay_id", "x", "y", "x", "y").select(F.col("bay_id").alias("__closest"), F.lit(True).alias("__blank"))
    known = bays.select(F.col("bay_id").alias("__known")).distinct()
    asked = orders.withColumn("__asked", F.nullif(F.trim(F.coalesce("bay_id", F.lit(""))), F.lit(""))).withColumn("__blank", F.col("__asked").isNull())
    named = asked.join(known, F.col("__asked") == F.col("__known"), "left").join(closest, "__blank", "left")
    out = named.withColumn("bay_id", F.when(F.col("__blank"), F.col("__closest")).otherwise(F.col("__known")))
    keep = [c for c in orders.columns]
    return out.filter("bay_id is not null").select(keep), named.filter(F.when(F.col("__blank"), F.col("__closest")).otherwise(F.col("__known")).isNull()).select(keep)


def override_messages(accepted: DataFrame, order: list, base: int | Column = 0) -> DataFrame:
    """Change-log rows of accepted orders: every order is announced, with full confidence."""
    return delta_log(accepted.withColumn("confidence", F.lit(1.0)), order, base)


def compare_results(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Per expected bay: ``match``, ``mismatch`` or ``missing``."""
    g = got.select("bay_id", F.col("occupied").alias("__got"), F.lit(True).alias("__has"))
    verdict = (F.when(F.col("__has").isNull(), "missing").when(F.col("__got").eqNullSafe(F.col("occupied")), "match").otherwise("mismatch"))
    return expected.join(g, "bay_id", "left").select("bay_id", verdict.alias("verdict"))


def retention_sweep(frames: DataFrame, jobs: DataFrame, deltas: DataFrame, as_of, keep_s: float = 14400, delta_keep_s: float = 3600):
    """``(frames kept, deltas kept, counts)``: terminal jobs' frames past retention go.

    Frames whose job never finished stay and are counted as stuck.
    """
    old = F.col("received_at") < minus_seconds(as_time(as_of), keep_s)
    expired = F.coalesce(F.col("created_at") < minus_seconds(as_time(as_of), delta_keep_s), F.lit(False))
    aged = frames.filter(old).join(jobs.select("frame_id", "status"), "frame_id")
    gone = aged.filter(F.col("status").isin("processed", "failed")).select("frame_id")
    kept = frames.join(gone, "frame_id", "left_anti")
    from .serve import side_by_side

    counts = side_by_side(aged.agg(
        count_if(F.col("status").isin("processed", "failed")).alias("frames_deleted"),
        count_if(F.col("status").isin("queued", "running")).alias("stuck"),
    ), deltas.agg(count_if(expired).alias("deltas_trimmed")))
    return kept, deltas.filter(~expired), counts
