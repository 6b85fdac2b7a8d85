"""Evidence, state, serving and pipeline-health queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geo
from ..operators import scan, serve, vote
from .adapters import AS_OF, WINDOW_S, view
from .registry import query

W = f"interval '{WINDOW_S} seconds'"
CUT = f"(timestamp '{AS_OF}' - {W})"
ACTIVE = f"(valid_from is null or valid_from <= timestamp '{AS_OF}') and (valid_to is null or valid_to > timestamp '{AS_OF}')"


def closures(spark, sf) -> DataFrame:
    c = view(spark, sf, "v_closure")
    corner = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    return c.withColumn("ring", F.array(*[geo.point(x, y) for x, y in corner]))


def voted(spark, sf) -> DataFrame:
    return vote.vote_states(view(spark, sf, "v_observation"), AS_OF, WINDOW_S)


def map_rows(spark, sf) -> DataFrame:
    return serve.bays_with_state(view(spark, sf, "v_bay"), view(spark, sf, "v_state"), closures(spark, sf), AS_OF, WINDOW_S)


VOTED = f"""latest as (select bay_id, mission_id from (select *, row_number() over (partition by bay_id order by observed_at desc, event_id desc) rn
  from v_observation where observed_at > {CUT}) t where rn = 1),
 agg as (select o.bay_id, o.mission_id, count(*) n, count(case when o.occupied then 1 end) occ, max(o.backend) backend
  from v_observation o join latest l on o.bay_id = l.bay_id and o.mission_id is not distinct from l.mission_id
  where o.observed_at > {CUT} group by o.bay_id, o.mission_id),
 voted as (select bay_id, mission_id, n, occ, occ*2>n occupied, greatest(occ,n-occ)/cast(n as double) confidence, backend from agg)"""

MAPPED = f"""hits as (select b.bay_id, c.*, row_number() over (partition by b.bay_id order by c.valid_from nulls first, c.closure_id) rn
  from v_bay b join v_closure c on b.x between c.x0 and c.x1 and b.y between c.y0 and c.y1 where {ACTIVE}),
 mapped as (select b.*, case when updated_at > {CUT} then occupied end occupied, case when updated_at > {CUT} then confidence end confidence,
  case when updated_at > {CUT} then backend end backend, last_frame, updated_at, source, h.closure_id, h.valid_to closure_until,
  h.closure_id is not null closed
  from v_bay b left join v_state s using (bay_id) left join hits h on h.bay_id = b.bay_id and h.rn = 1)"""


@query("AGG01_vote_states", f"with {VOTED} select * from voted")
def agg01(spark, sf):
    return voted(spark, sf)


@query("AGG02_state_changes", f"""with {VOTED} select v.bay_id, v.occupied, round(v.confidence, 3) confidence
 from voted v left join v_state p using (bay_id) where p.bay_id is null or p.occupied is distinct from v.occupied""")
def agg02(spark, sf):
    return vote.state_changes(view(spark, sf, "v_state"), voted(spark, sf))


@query("AGG03_vote_views", """select bay_id, count(case when occupied then 1 end)*2 > count(*) occupied, count(*) views,
 count(case when occupied then 1 end) n_occ from v_observation group by bay_id""")
def agg03(spark, sf):
    return vote.vote_views(view(spark, sf, "v_observation"))


@query("AGG03_views_overview", """with v as (select bay_id, count(*) views, count(case when occupied then 1 end)*2 > count(*) occupied from v_observation group by bay_id),
 r as (select *, row_number() over (order by views) rn, count(*) over () n from v)
 select count(*) bays, count(case when occupied then 1 end) occupied, count(case when views=1 then 1 end) single_view, min(views) views_min,
 max(case when rn = n//2 + 1 then views end) views_median, max(views) views_max from r""")
def agg03b(spark, sf):
    return vote.views_overview(vote.vote_views(view(spark, sf, "v_observation")))


@query("AGG04_vote_with_best_view", """with o as (select bay_id, occupied, event_id frame_idx, (event_id%4)/4.0e0 vis, (event_id%97)*1.5e0 off, backend from v_observation),
 r as (select *, row_number() over (partition by bay_id order by vis desc, off, frame_idx) rn, count(*) over (partition by bay_id) views,
 count(case when occupied then 1 end) over (partition by bay_id) n_occ from o)
 select bay_id, n_occ*2>views occupied, views, n_occ, frame_idx, vis, off, backend from r where rn=1""")
def agg04(spark, sf):
    o = view(spark, sf, "v_observation").select(
        "bay_id", "occupied", F.col("event_id").alias("frame_idx"), (F.col("event_id") % 4 / F.lit(4.0)).alias("vis"),
        (F.col("event_id") % 97 * F.lit(1.5)).alias("off"), "backend")
    return vote.vote_with_best_view(o, ["vis", "off", "backend"])


@query("AGG04_uncovered", "select * from v_bay b where not exists (select 1 from v_observation o where o.bay_id = b.bay_id)")
def agg04b(spark, sf):
    return vote.uncovered(view(spark, sf, "v_bay"), view(spark, sf, "v_observation"))


@query("AGG05_zone_summary", f"""with {MAPPED} select zona, count(case when not closed and occupied=false then 1 end) free,
 count(case when not closed and occupied then 1 end) occupied, count(case when not closed and occupied is null then 1 end) as "unknown",
 count(case when closed then 1 end) closed from mapped group by zona""")
def agg05(spark, sf):
    return serve.zone_summary(map_rows(spark, sf))


@query("AGG06_coverage_counts", f"""with {MAPPED}, c as (select count(*) t, count(case when not closed and occupied=false then 1 end) f,
 count(case when not closed and occupied then 1 end) o, count(case when closed then 1 end) c from mapped)
 select t bays_total, o bays_occupied, f bays_free, c bays_closed, t-o-f-c bays_unknown, o/cast(greatest(1,t) as double) occupied_share,
 f/cast(greatest(1,t) as double) free_share, c/cast(greatest(1,t) as double) closed_share, (t-o-f-c)/cast(greatest(1,t) as double) unknown_share from c""")
def agg06(spark, sf):
    return serve.coverage_counts(map_rows(spark, sf))


@query("AGG07_job_counts", f"""select count(case when status='queued' then 1 end) queued, count(case when status='running' then 1 end) running,
 count(case when status='processed' then 1 end) processed, count(case when status='failed' then 1 end) failed,
 round((epoch_us(timestamp '{AS_OF}') - epoch_us(min(case when status='queued' then enqueued_at end)))/1e6, 1) oldest_queued_age_s,
 count(case when status='running' and lease_expires_at < timestamp '{AS_OF}' then 1 end) expired_leases from v_job""")
def agg07(spark, sf):
    return serve.job_counts(view(spark, sf, "v_job"), AS_OF)


@query("AGG08_unassigned_counts", f"""select count(*) frames_measured, cast(coalesce(sum(unassigned_dets),0) as bigint) unassigned,
 cast(coalesce(sum(unassigned_near),0) as bigint) unassigned_near, round(sum(unassigned_dets)/nullif(cast(count(*) as double),0), 2) unassigned_per_frame
 from v_job where unassigned_dets is not null and finished_at > {CUT}""")
def agg08(spark, sf):
    return serve.unassigned_counts(view(spark, sf, "v_job"), AS_OF, WINDOW_S)


@query("AGG09_ingest_rates", f"""select count(case when received_at > timestamp '{AS_OF}' - interval '1 minute' then 1 end) frames_last_1m,
 count(case when received_at > timestamp '{AS_OF}' - interval '1 hour' then 1 end) frames_last_1h,
 count(case when received_at > {CUT} then 1 end) frames_in_window,
 round(count(case when received_at > {CUT} then 1 end)*60.0e0/{WINDOW_S}.0e0, 2) frames_per_min_window, max(received_at) last_frame_at from v_frame""")
def agg09(spark, sf):
    return serve.ingest_rates(view(spark, sf, "v_frame"), AS_OF, WINDOW_S)


LAT = f"(select status, (epoch_us(finished_at)-epoch_us(enqueued_at))/1e6 took from v_job where finished_at > {CUT})"


@query("AGG10_classify_latency", f"""select count(*) finished_in_window, round(avg(took),3) avg_s, round(quantile_cont(took,0.5),3) p50_s,
 round(quantile_cont(took,0.95),3) p95_s, count(case when status='failed' then 1 end) failed_in_window,
 round(count(case when status='failed' then 1 end)/nullif(cast(count(*) as double),0),4) failure_rate from {LAT} t""")
def agg10(spark, sf):
    return serve.classify_latency(view(spark, sf, "v_job"), AS_OF, WINDOW_S)


def fleet(spark, sf):
    frames = view(spark, sf, "v_frame")
    drones = frames.groupBy("drone_id").agg(F.max("received_at").alias("last_seen"))
    missions = frames.groupBy(F.concat("drone_id", F.lit("-"), F.coalesce("mission_id", F.lit("none"))).alias("mission_id")).agg(
        F.min("drone_id").alias("drone_id"), F.min("received_at").alias("started_at"), F.count(F.lit(1)).alias("frames_done"),
        F.when(F.max("mission_id") == "m2", F.max("received_at")).alias("ended_at"))
    own = frames.withColumn("mission_id", F.concat("drone_id", F.lit("-"), F.coalesce("mission_id", F.lit("none"))))
    return drones, missions, own


FLEET = """own as (select *, concat(drone_id,'-',coalesce(mission_id,'none')) mid from v_frame),
 drones as (select drone_id, max(received_at) last_seen from v_frame group by 1),
 missions as (select mid mission_id, min(drone_id) drone_id, min(received_at) started_at, count(*) frames_done,
 case when max(mission_id)='m2' then max(received_at) end ended_at from own group by 1)"""


@query("AGG11_drone_activity", f"""with {FLEET} select count(*) drones_total, count(case when last_seen > {CUT} then 1 end) drones_active from drones""")
def agg11(spark, sf):
    return serve.drone_activity(fleet(spark, sf)[0], AS_OF, WINDOW_S)


@query("AGG11_fleet_missions", f"""with {FLEET} select m.*, round((epoch_us(timestamp '{AS_OF}')-epoch_us(max(o.received_at)))/1e6,1) since_last_frame_s
 from missions m left join own o on o.mid=m.mission_id where ended_at is null group by all order by started_at desc, m.mission_id limit 20""")
def agg11b(spark, sf):
    _, missions, frames = fleet(spark, sf)
    return serve.open_missions(missions, frames, AS_OF)


@query("AGG11_fleet_health", f"""with {FLEET}, o as (select m.mission_id, m.started_at from missions m where ended_at is null order by started_at desc, m.mission_id limit 20)
 select (select count(*) from drones) drones_total, (select count(case when last_seen > {CUT} then 1 end) from drones) drones_active, (select count(*) from o) missions_active, (select string_agg(mission_id, ',' order by started_at desc, mission_id) from o) missions""")
def agg11c(spark, sf):
    drones, missions, frames = fleet(spark, sf)
    out = serve.fleet_health(drones, missions, frames, AS_OF, WINDOW_S)
    listed = F.array_sort("missions", lambda a, b: F.when(a["started_at"] != b["started_at"], F.when(a["started_at"] > b["started_at"], -1).otherwise(1)).when(a["mission_id"] < b["mission_id"], -1).when(a["mission_id"] > b["mission_id"], 1).otherwise(0))
    return out.withColumn("missions", F.array_join(F.transform(listed, lambda m: m["mission_id"]), ","))


@query("AGG12_model_accuracy", f"""with l as (select bay_id, gt from (select *, row_number() over (partition by bay_id order by observed_at desc, event_id desc) rn
 from v_observation where gt is not null) t where rn=1),
 v as (select count(*) vs, count(case when occupied=gt then 1 end) vc from v_observation where gt is not null),
 b as (select count(*) bs, count(case when s.occupied=l.gt then 1 end) bc from l join v_state s using (bay_id))
 select vs views_scored, vc views_correct, bs bays_scored, bc bays_correct, round(vc/nullif(cast(vs as double),0),4) view_accuracy,
 round(bc/nullif(cast(bs as double),0),4) state_accuracy from v, b""")
def agg12(spark, sf):
    return serve.model_accuracy(view(spark, sf, "v_observation"), view(spark, sf, "v_state"))


RSTATE = """rstate as (select run_id, count(*) cars, count(distinct frame_idx)%7 as "free", count(*)+3 capacity_observed, max(observed_at) updated_at from v_span group by run_id)"""


def run_states(spark, sf):
    s = view(spark, sf, "v_span")
    return s.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("cars"), (F.count_distinct("frame_idx") % 7).alias("free"), (F.count(F.lit(1)) + 3).alias("capacity_observed"),
        F.max("observed_at").alias("updated_at"))


def _totals_sql(join):
    c = "timestamp '2024-01-30 22:00:00' - interval '7200 seconds'"
    return f"""with {RSTATE} select count(*) runs, cast(coalesce(sum(case when updated_at>{c} then cars end),0) as bigint) cars,
 cast(coalesce(sum(case when updated_at>{c} then free end),0) as bigint) as "free",
 cast(coalesce(sum(case when updated_at>{c} then capacity_observed end),0) as bigint) capacity_observed,
 cast(coalesce(sum(capacity),0) as bigint) capacity_total from v_run {join} join rstate using (run_id)"""


@query("AGG13_run_totals", _totals_sql(""))
def agg13(spark, sf):
    return serve.run_totals(view(spark, sf, "v_run"), run_states(spark, sf), "2024-01-30 22:00:00")


@query("AGG13_run_totals_map", _totals_sql("left"))
def agg13b(spark, sf):
    return serve.run_totals(view(spark, sf, "v_run"), run_states(spark, sf), "2024-01-30 22:00:00", every_run=True)


@query("AGG19_backfill_mission", """with f as (select survey_area, frame_idx, min(mission_id) m from
 (select survey_area, frame_idx % 50 frame_idx, mission_id from v_observation where mission_id is not null and survey_area <> 'a1' or frame_idx%3=0) t
 group by 1,2 having count(distinct mission_id)=1)
 select o.event_id, coalesce(o.mission_id, f.m) mission_id from v_observation o left join f on o.survey_area=f.survey_area and o.frame_idx=f.frame_idx""")
def agg19(spark, sf):
    obs = view(spark, sf, "v_observation")
    frames = (obs.filter("mission_id is not null and survey_area <> 'a1' or frame_idx%3=0")
              .select("survey_area", (F.col("frame_idx") % 50).alias("frame_idx"), "mission_id"))
    return vote.backfill_mission(obs, frames).select("event_id", "mission_id")


def _long_metrics(spark, sf):
    j = serve.long_metrics(serve.job_counts(view(spark, sf, "v_job"), AS_OF), "survey_jobs", ["queued", "running", "processed", "failed", "expired_leases"])
    late = serve.classify_latency(view(spark, sf, "v_job"), "2030-01-01 00:00:00", WINDOW_S)
    return j.unionByName(serve.long_metrics(late, "survey_latency", ["p50_s", "p95_s"]))


@query("SNK02_prometheus_lines", """with c as (select count(case when status='queued' then 1 end) queued, count(case when status='running' then 1 end) running,
 count(case when status='processed' then 1 end) processed, count(case when status='failed' then 1 end) failed,
 count(case when status='running' and lease_expires_at < timestamp '2024-01-31 00:00:00' then 1 end) expired_leases from v_job),
 m as (unpivot c on queued, running, processed, failed, expired_leases into name n value v)
 select concat('survey_jobs_', n) name, p.part, case p.part when 0 then concat('# HELP survey_jobs_', n, ' ') when 1 then concat('# TYPE survey_jobs_', n, ' gauge')
 else concat('survey_jobs_', n, ' ', cast(cast(v as double) as varchar)) end line from m, (values (0),(1),(2)) p(part)""")
def snk02(spark, sf):
    return serve.prometheus_lines(_long_metrics(spark, sf))


@query("AGG33_metrics_snapshot", f"""with a as (select count(case when status='queued' then 1 end) q, count(case when status='failed' then 1 end) fl from v_job),
 b as (select count(case when received_at > {CUT} then 1 end) w from v_frame), c as (select count(case when unassigned_dets is not null and finished_at > {CUT} then 1 end) u from v_job),
 d as (select count(*) n, round(quantile_cont(took,0.95),3) p from {LAT} t), e as (select count(*) v from v_observation where gt is not null)
 select q jobs_queued, fl jobs_failed, w ingest_window, u unassigned_frames, n latency_n, p latency_p95, v model_views from a,b,c,d,e""")
def agg33(spark, sf):
    jobs = view(spark, sf, "v_job")
    snap = serve.metrics_snapshot(
        jobs=serve.job_counts(jobs, AS_OF), ingest=serve.ingest_rates(view(spark, sf, "v_frame"), AS_OF, WINDOW_S),
        latency=serve.classify_latency(jobs, AS_OF, WINDOW_S), unassigned=serve.unassigned_counts(jobs, AS_OF, WINDOW_S),
        model=serve.model_accuracy(view(spark, sf, "v_observation"), view(spark, sf, "v_state")))
    return snap.select(
        F.col("jobs.queued").alias("jobs_queued"), F.col("jobs.failed").alias("jobs_failed"), F.col("ingest.frames_in_window").alias("ingest_window"),
        F.col("unassigned.frames_measured").alias("unassigned_frames"), F.col("latency.finished_in_window").alias("latency_n"),
        F.col("latency.p95_s").alias("latency_p95"), F.col("model.views_scored").alias("model_views"))


# ---- tables -----------------------------------------------------------------

@query("SNK03_upsert", """select bay_id, occupied, confidence, updated_at from (select *, row_number() over (partition by bay_id order by updated_at desc, src) rn from (
 select bay_id, occupied, confidence, updated_at, 0 src from v_state union all
 select bay_id, occupied, conf, observed_at, 1 from (select bay_id, occupied, 1.0e0 conf, observed_at, row_number() over (partition by bay_id order by observed_at desc, event_id desc) rn
 from v_observation) u where rn=1) t) z where rn=1""")
def snk03(spark, sf):
    obs = view(spark, sf, "v_observation")
    newest = scan.latest_per_key(obs, ["bay_id"], F.struct("observed_at", "event_id"))
    updates = newest.select("bay_id", "occupied", F.lit(1.0).alias("confidence"), F.col("observed_at").alias("updated_at"))
    return vote.upsert(view(spark, sf, "v_state").select(*updates.columns), updates, ["bay_id"], monotonic="updated_at")


@query("SNK04_append_observations", """with old as (select * from v_observation where event_id%2=0), fresh as (select * from v_observation where event_id%2=1)
 select event_id, frame_id, bay_id from (select *, row_number() over (partition by frame_id, bay_id order by event_id) rn from fresh where frame_id is not null) f
 where rn=1 and not exists (select 1 from old o where o.frame_id=f.frame_id and o.bay_id=f.bay_id)
 union all select event_id, frame_id, bay_id from fresh where frame_id is null""")
def snk04(spark, sf):
    obs = view(spark, sf, "v_observation")
    return vote.append_observations(obs.filter("event_id%2=0"), obs.filter("event_id%2=1"), F.col("event_id")).select("event_id", "frame_id", "bay_id")


@query("SNK05_ingest_frames", """with k as (select *, coalesce(mission_id, concat('area:',survey_area)) mk, cast(substr(frame_id,2) as bigint) n from v_frame),
 held as (select drone_id, mk, frame_idx, min(frame_id) h from k where n%2=0 group by 1,2,3),
 f as (select *, first_value(frame_id) over (partition by drone_id, mk, frame_idx order by n) f from k where n%2=1)
 select f.frame_id, coalesce(h, f) stored_id, f.frame_id <> coalesce(h, f) duplicate from f left join held using (drone_id, mk, frame_idx)""")
def snk05(spark, sf):
    f = view(spark, sf, "v_frame").withColumn("n", F.expr("cast(substr(frame_id,2) as bigint)"))
    return vote.ingest_frames(f.filter("n%2=0"), f.filter("n%2=1"), F.col("n"))


@query("SNK06_replace_frame_evidence", """with old as (select * from v_observation where event_id%2=0), fresh as (select * from v_observation where event_id%2=1)
 select event_id, frame_id, 'old' src from old where frame_id is null or frame_id not in (select frame_id from fresh where frame_id is not null)
 union all select event_id, frame_id, 'new' from fresh""")
def snk06(spark, sf):
    obs = view(spark, sf, "v_observation").select("event_id", "frame_id")
    return vote.replace_frame_evidence(obs.filter("event_id%2=0").withColumn("src", F.lit("old")),
                                       obs.filter("event_id%2=1").withColumn("src", F.lit("new")))


def _area_tables(spark, sf):
    return {"observation": view(spark, sf, "v_observation"), "frame": view(spark, sf, "v_frame"), "bay_state": view(spark, sf, "v_state")}


@query("SNK08_delete_area", """select 'observation' table_name, count(*) deleted from v_observation where survey_area='a1'
 union all select 'frame', count(*) from v_frame where survey_area='a1'
 union all select 'bay_state', count(*) from v_state where bay_id in (select bay_id from v_observation where survey_area='a1')""")
def snk08(spark, sf):
    return vote.delete_area(_area_tables(spark, sf), "a1", {"observation": "survey_area", "frame": "survey_area"})[1]


@query("SNK09_area_census", """select survey_area, cast(sum(f) as bigint) frames, cast(sum(o) as bigint) observations from
 (select survey_area, 1 f, 0 o from v_frame union all select survey_area, 0, 1 from v_observation) t group by 1""")
def snk09(spark, sf):
    return vote.area_census({"frames": view(spark, sf, "v_frame"), "observations": view(spark, sf, "v_observation")})


# ---- predicates and map joins -------------------------------------------------

@query("PRJ05_is_fresh", f"""select bay_id, updated_at > {CUT} fresh, case when updated_at > {CUT} then backend end backend from v_state""")
def prj05(spark, sf):
    s = view(spark, sf, "v_state")
    fresh = serve.is_fresh("updated_at", AS_OF, WINDOW_S)
    return s.select("bay_id", fresh.alias("fresh"), F.when(fresh, F.col("backend")).alias("backend"))


@query("PRJ06_is_active", f"""select status, count(case when (enqueued_at <= timestamp '2024-01-15 00:00:00') and (finished_at is null or finished_at > timestamp '2024-01-15 00:00:00') then 1 end) active,
 count(*) n from v_job group by status""")
def prj06(spark, sf):
    from ..functions.numeric import count_if
    return view(spark, sf, "v_job").groupBy("status").agg(
        count_if(serve.is_active("enqueued_at", "finished_at", "2024-01-15 00:00:00")).alias("active"), F.count(F.lit(1)).alias("n"))


STATUS_SQL = f"case when closed then 'closed' when coalesce(updated_at > {CUT}, false) and occupied is not null then case when occupied then 'occupied' else 'free' end else 'unknown' end"


@query("PRJ07_bay_status", f"with {MAPPED} select bay_id, {STATUS_SQL} status from mapped")
def prj07(spark, sf):
    return map_rows(spark, sf).select("bay_id", serve.bay_status("closed", "occupied", "updated_at", AS_OF, WINDOW_S).alias("status"))


@query("PRJ03_bbox_filter", """select bay_id from v_bay where x-2.7 <= 120.0 and x+2.7 >= 30.0 and y-1.1 <= 200.0 and y+1.1 >= 20.0 and zona='BUILDING'""")
def prj03(spark, sf):
    b = view(spark, sf, "v_bay").withColumns({"min_x": F.col("x") - 2.7, "max_x": F.col("x") + 2.7, "min_y": F.col("y") - 1.1, "max_y": F.col("y") + 1.1})
    return serve.bbox_filter(b, (30.0, 20.0, 120.0, 200.0), "BUILDING").select("bay_id")


@query("JON01_bays_with_state", f"with {MAPPED} select bay_id, zona, occupied, confidence, backend, last_frame, updated_at, closure_id, closure_until, closed from mapped")
def jon01(spark, sf):
    return map_rows(spark, sf).select("bay_id", "zona", "occupied", "confidence", "backend", "last_frame", "updated_at", "closure_id", "closure_until", "closed")


@query("JON02_closed_bays", f"with {MAPPED} select bay_id, closure_id, valid_from, valid_to from hits where rn=1")
def jon02(spark, sf):
    return serve.closed_bays(view(spark, sf, "v_bay"), closures(spark, sf), AS_OF)


@query("JON03_bays_in_closure", "select bay_id from v_bay b join v_closure c on b.x between x0 and x1 and b.y between y0 and y1 where closure_id='c3'")
def jon03(spark, sf):
    return serve.bays_in_closure(view(spark, sf, "v_bay"), closures(spark, sf), "c3")


@query("JON03_closures_with_counts", f"""select closure_id, valid_from, valid_to, (select count(*) from v_bay b where b.x between x0 and x1 and b.y between y0 and y1) bays
 from v_closure where {ACTIVE}""")
def jon03b(spark, sf):
    return serve.closures_with_counts(view(spark, sf, "v_bay"), closures(spark, sf), AS_OF).select("closure_id", "valid_from", "valid_to", "bays")


@query("JON25_merge_live", """with d as (select bay_id, case when event_id%7=0 then null else occupied end occupied, observed_at tm, row_number() over (partition by bay_id order by event_id desc) rn
 from v_observation)
 select s.bay_id, case when d.bay_id is not null then d.occupied else s.occupied end occupied, case when d.bay_id is not null then d.tm else s.updated_at end updated_at
 from v_state s left join d on d.bay_id=s.bay_id and d.rn=1""")
def jon25(spark, sf):
    d = view(spark, sf, "v_observation").select(
        "bay_id", F.expr("case when event_id%7=0 then null else occupied end").alias("occupied"), F.col("observed_at").alias("updated_at"), "event_id")
    return vote.merge_live(view(spark, sf, "v_state").select("bay_id", "occupied", "updated_at"), d, "event_id")


@query("JON26_compare_results", f"""with {VOTED} select s.bay_id, case when v.bay_id is null then 'missing' when v.occupied is not distinct from s.occupied then 'match' else 'mismatch' end verdict
 from v_state s left join voted v using (bay_id)""")
def jon26(spark, sf):
    return vote.compare_results(view(spark, sf, "v_state"), voted(spark, sf))


@query("WIN04_latest_per_key", """select bay_id, event_id, gt from (select *, row_number() over (partition by bay_id order by observed_at desc, event_id desc) rn
 from v_observation where gt is not null) t where rn=1""")
def win04(spark, sf):
    o = view(spark, sf, "v_observation").filter("gt is not null")
    return scan.latest_per_key(o, ["bay_id"], F.struct("observed_at", "event_id")).select("bay_id", "event_id", "gt")


@query("WIN24_bay_history", """select bay_id, event_id, occupied, observed_at, cast(rn as int) rank from (select *, row_number() over (partition by bay_id order by observed_at desc, event_id desc) rn
 from v_observation) t where rn<=20""")
def win24(spark, sf):
    return vote.bay_history(view(spark, sf, "v_observation")).select("bay_id", "event_id", "occupied", "observed_at", "rank")


# ---- change stream, batch side --------------------------------------------------

CHANGES = f"""{VOTED}, ch as (select v.bay_id, v.occupied, round(v.confidence, 3) confidence, cast(row_number() over (order by v.bay_id) as bigint) cursor
 from voted v left join v_state p using (bay_id) where p.bay_id is null or p.occupied is distinct from v.occupied)"""


def change_log(spark, sf):
    return vote.delta_log(vote.state_changes(view(spark, sf, "v_state"), voted(spark, sf)), ["bay_id"])


@query("STR04_delta_log", f"""with {CHANGES} select cursor, bay_id, concat('{{"type":"bay_delta","bay_id":"', bay_id, '","occupied":', cast(occupied as varchar), ',"confidence":',
 cast(confidence as varchar), ',"cursor":"', cast(cursor as varchar), '"}}') payload from ch""")
def str04(spark, sf):
    return change_log(spark, sf)


@query("STR05_replay", f"with {CHANGES} select cursor, bay_id from ch where cursor > greatest(60-50,0) order by cursor limit 25")
def str05(spark, sf):
    return vote.replay(change_log(spark, sf), 60, limit=25).select("cursor", "bay_id")


@query("STR05_head", f"with {CHANGES} select coalesce(max(cursor),0) head from ch")
def str05b(spark, sf):
    return vote.head(change_log(spark, sf))


@query("STR06_closure_deltas", f"""with aft as (select * from v_closure where closure_id <> 'c1'), hits as (select distinct b.bay_id from v_bay b join aft c on b.x between c.x0 and c.x1 and b.y between c.y0 and c.y1 where {ACTIVE}),
 t as (select distinct b.bay_id from v_bay b join v_closure c on b.x between c.x0 and c.x1 and b.y between c.y0 and c.y1 where c.closure_id in ('c1','c3'))
 select t.bay_id, case when updated_at > {CUT} then occupied end occupied, case when updated_at > {CUT} then confidence end confidence, updated_at,
 case when h.bay_id is not null then true else false end closed
 from t left join v_state s using (bay_id) left join (select * from hits where bay_id not in (select bay_id from v_bay b join v_closure c on b.x between c.x0 and c.x1 and b.y between c.y0 and c.y1 where c.closure_id='c3')
 union select b.bay_id from v_bay b join aft c on b.x between c.x0 and c.x1 and b.y between c.y0 and c.y1 where c.closure_id in ('c2') ) h using (bay_id)""")
def str06(spark, sf):
    # c1 is removed and c3 ends now
    before = closures(spark, sf)
    after = before.filter("closure_id <> 'c1'").withColumn(
        "valid_to", F.when(F.col("closure_id") == "c3", F.lit(AS_OF).cast("timestamp_ntz")).otherwise(F.col("valid_to")))
    return serve.closure_deltas(view(spark, sf, "v_bay"), view(spark, sf, "v_state"), before, after, AS_OF, WINDOW_S)


@query("STR07_retention_sweep", """with c as (select timestamp '2024-01-20 00:00:00' - interval '14400 seconds' cut, timestamp '2024-01-20 00:00:00' - interval '3600 seconds' dcut),
 a as (select f.frame_id, j.status from v_frame f join v_job j on f.frame_id = concat('g', cast(j.frame_id as varchar)), c where f.received_at < c.cut)
 select count(case when status in ('processed','failed') then 1 end) frames_deleted, count(case when status in ('queued','running') then 1 end) stuck,
 (select count(*) from v_observation, c where observed_at < c.dcut) deltas_trimmed from a""")
def str07(spark, sf):
    jobs = view(spark, sf, "v_job").withColumn("frame_id", F.concat(F.lit("g"), F.col("frame_id").cast("string")))
    deltas = view(spark, sf, "v_observation").withColumnRenamed("observed_at", "created_at")
    return vote.retention_sweep(view(spark, sf, "v_frame"), jobs, deltas, "2024-01-20 00:00:00")[2]


@query("STR08_ingest_series", "select date_trunc('minute', received_at) started, count(*) frames from v_frame group by 1 order by 1 desc limit 180")
def str08(spark, sf):
    return serve.ingest_series(view(spark, sf, "v_frame"))


@query("STR09_liveness", "select drone_id, max(received_at) last_seen from v_frame group by 1")
def str09(spark, sf):
    return serve.liveness(view(spark, sf, "v_frame"))[0]


@query("STR09_mission_progress", "select mission_id, count(*) frames_done, max(received_at) last_frame_at from v_frame where mission_id is not null group by 1")
def str09b(spark, sf):
    return serve.liveness(view(spark, sf, "v_frame"))[1]


@query("STR10_manual_override", """with m as (select bay_id, occupied, observed_at tm from (select *, row_number() over (partition by bay_id order by observed_at desc, occupied desc) rn
 from v_observation where event_id%11=0) t where rn=1)
 select coalesce(m.bay_id, s.bay_id) bay_id, case when m.bay_id is not null and (s.bay_id is null or m.tm > s.updated_at) then m.occupied else s.occupied end occupied,
 case when m.bay_id is not null and (s.bay_id is null or m.tm > s.updated_at) then 1.0e0 else s.confidence end confidence,
 case when m.bay_id is not null and (s.bay_id is null or m.tm > s.updated_at) then 'manual' else s.source end source,
 case when m.bay_id is not null and (s.bay_id is null or m.tm > s.updated_at) then m.tm else s.updated_at end updated_at
 from v_state s full join m on m.bay_id=s.bay_id""")
def str10(spark, sf):
    orders = view(spark, sf, "v_observation").filter("event_id%11=0").select("bay_id", "occupied", F.col("observed_at").alias("at"))
    return vote.manual_override(view(spark, sf, "v_state"), orders)


ORDERS = "select event_id, case when event_id%3=0 then ' ' when event_id%5=0 then concat('x', bay_id) else bay_id end bay_id, occupied, observed_at from v_observation where occupied is not null"


def orders(spark, sf):
    return view(spark, sf, "v_observation").filter("occupied is not null").select("event_id", F.expr("case when event_id%3=0 then ' ' when event_id%5=0 then concat('x', bay_id) else bay_id end").alias("bay_id"), "occupied")


RESOLVED = f"""o as ({ORDERS}), c as (select bay_id cb from v_bay order by sqrt(pow(x-100.0e0,2)+pow(y-30.0e0,2)), bay_id limit 1),
 r as (select o.event_id, o.bay_id asked, case when trim(o.bay_id)='' then c.cb else b.bay_id end target, o.occupied from o cross join c left join v_bay b on b.bay_id=trim(o.bay_id))"""


@query("STR10_override_messages", f"""with {RESOLVED} select row_number() over (order by event_id) "cursor", target bay_id, occupied from r where target is not null""")
def str10b(spark, sf):
    accepted, _ = vote.resolve_orders(orders(spark, sf), view(spark, sf, "v_bay"), 100.0, 30.0)
    log = vote.override_messages(accepted, ["event_id"])
    return log.select("cursor", "bay_id", F.get_json_object("payload", "$.occupied").cast("boolean").alias("occupied"))


@query("STR10_refused_orders", f"with {RESOLVED} select event_id, asked bay_id from r where target is null")
def str10c(spark, sf):
    return vote.resolve_orders(orders(spark, sf), view(spark, sf, "v_bay"), 100.0, 30.0)[1].select("event_id", "bay_id")


@query("STR11_flight_sessions", """with g as (select *, case when received_at >= lag(received_at) over w + interval '30 minutes' then 1 else 0 end brk from v_frame window w as (partition by drone_id order by received_at)),
 i as (select *, sum(brk) over (partition by drone_id order by received_at) sid from g)
 select drone_id, min(received_at) started, max(received_at) last_at, count(*) frames from i group by drone_id, sid""")
def str11(spark, sf):
    return serve.flight_sessions(view(spark, sf, "v_frame"), "received_at", ["drone_id"], "30 minutes")
