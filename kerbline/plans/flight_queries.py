"""Flight, telemetry, label-set and file round-trip queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import datasets, flights, stats
from ..operators.serve import side_by_side
from ..session import scratch_path
from ..sources import features, frames, sinks
from .adapters import table, view
from .evaluation_queries import SHOT, shots
from .geometry_queries import ringed
from .kerb_queries import lines
from .registry import query


def r(c, n=4):
    return F.round(c, n)


def ev(spark, sf, sql):
    return spark.sql(sql.replace("from events", f"from parquet.`{sf}/events.parquet`").replace("from lineitem", f"from parquet.`{sf}/lineitem.parquet`"))


TRACK = "(select flight, idx, x, y, t from v_track)"


@query("WIN18_track_motion", """select flight, idx, round(sqrt(pow(x-px,2)+pow(y-py,2)),4) step_m, case when pow(x-px,2)+pow(y-py,2)>0 then round(atan2(y-py,x-px),6) end course,
 round(sqrt(pow(x-px,2)+pow(y-py,2))/nullif((epoch_us(t)-epoch_us(pt))/1e6,0.0e0),6) speed from (select *, lag(x) over w px, lag(y) over w py, lag(t) over w pt from v_track window w as (partition by flight order by idx)) q""")
def win18(spark, sf):
    m = flights.track_motion(view(spark, sf, "v_track").select("flight", "idx", "x", "y", "t"), ["flight"], t="t", chunk=1000)
    return m.select("flight", "idx", r(F.col("step_m")).alias("step_m"), r(F.col("course"), 6).alias("course"), r(F.col("speed"), 6).alias("speed"))


@query("WIN18_track_summary", """select flight, count(*) poses, round(coalesce(sum(st),0.0e0),3) length_m, round(avg(st),4) spacing_m from (select flight, sqrt(pow(x-lag(x) over w,2)+pow(y-lag(y) over w,2)) st from v_track window w as (partition by flight order by idx)) q group by 1""")
def win18b(spark, sf):
    m = flights.track_motion(view(spark, sf, "v_track").select("flight", "idx", "x", "y"), ["flight"], chunk=1000)
    return flights.track_summary(m, ["flight"]).select("flight", "poses", r(F.col("length_m"), 3).alias("length_m"), r(F.col("spacing_m")).alias("spacing_m"))


SHIFT = """(select flight, idx, row_number() over (partition by flight order by idx) n, x-lag(x) over w dx, y-lag(y) over w dy, 40.0e0+k du, 300.0e0-value dv, (k%10)/10.0e0 score from v_track window w as (partition by flight order by idx))"""


def shifts(spark, sf):
    from ..operators.scan import chunk_of, ordered_scan
    t = ordered_scan(view(spark, sf, "v_track"), ["flight"], ["idx"], chunk_of("idx", 1000), lag={"px": "x", "py": "y"}, row_number="n")
    return t.select("flight", "idx", "n", (F.col("x") - F.col("px")).alias("dx"), (F.col("y") - F.col("py")).alias("dy"), (F.lit(40.0) + F.col("k")).alias("du"),
                    (F.lit(300.0) - F.col("value")).alias("dv"), (F.col("k") % 10 / F.lit(10.0)).alias("score"))


HEAD = f"""s as {SHIFT}, h0 as (select *, atan2(dy,dx)+atan2(-du,dv) a, sqrt(dx*dx+dy*dy)/sqrt(du*du+dv*dv) gsd from s where dx is not null and sqrt(dx*dx+dy*dy)>=3 and score>=0.3e0),
 h as (select *, a-2*pi()*floor(a/(2*pi())) yaw, atan2(dy,dx) course from h0)"""


@query("WIN19_heading_from_shift", f"with {HEAD} select flight, idx, round(yaw,6) yaw, round(gsd,6) gsd from h where abs(gsd/0.25e0-1)<=0.25e0")
def win19(spark, sf):
    h = flights.gsd_gate(flights.heading_from_shift(shifts(spark, sf)), 0.25)
    return h.select("flight", "idx", r(F.col("yaw"), 6).alias("yaw"), r(F.col("gsd"), 6).alias("gsd"))


WRAP = "({0}+pi())-2*pi()*floor(({0}+pi())/(2*pi()))-pi()"
BIN = f"{2 * math.pi / 3600!r}e0"


# Poses before the flight's first one have no heading near them and take the flight's middle course.
@query("WIN20_circ_median", f"""with {HEAD}, g as (select flight, n, round(yaw,4) yaw from h), po as (select flight, n from s union all select flight, -n from s), c as (select p.flight, p.n, g.yaw from po p join g on g.flight=p.flight and abs(g.n-p.n)<=5),
 k as (select a.flight, a.n, a.yaw, round(sum(abs({WRAP.format('(b.yaw-a.yaw)')})),6) cost from (select distinct flight, n, yaw from c) a join c b on a.flight=b.flight and a.n=b.n group by a.flight, a.n, a.yaw),
 fl as (select flight, n, yaw from k qualify row_number() over (partition by flight, n order by cost, yaw) = 1),
 hb as (select flight, b, count(*) n from (select flight, cast(round_even(course/{BIN},0) as bigint) rb, ((rb%3600)+3600)%3600 b from h) t group by 1,2), ha as (select flight, n, {WRAP.format(f'(b*{BIN})')} a from hb),
 kc as (select x.flight, x.a, round(sum(abs({WRAP.format('(y.a-x.a)')})*y.n),6) cost from ha x join ha y on x.flight=y.flight group by 1,2), co as (select flight, a from kc qualify row_number() over (partition by flight order by cost, a) = 1)
 select po.flight, po.n idx, round(coalesce(fl.yaw, co.a),6) yaw, case when fl.yaw is not null then 'flow' when co.a is not null then 'course' end yaw_src from po left join fl on fl.flight=po.flight and fl.n=po.n left join co on co.flight=po.flight""")
def win20(spark, sf):
    s = shifts(spark, sf)
    good = flights.heading_from_shift(s).select("flight", F.col("n").alias("idx"), r(F.col("yaw")).alias("yaw"), "course")
    poses = s.select("flight", F.col("n").alias("idx"))
    return flights.smooth_heading(poses.unionByName(poses.withColumn("idx", -F.col("idx"))), good)


# Braking ahead of every later point at once: v^2 is the least of corner^2 + 2aD over the rest of the way, less 2aD here.
@query("WIN21_speed_profile", f"""with p as (select flight, idx, x, y, lag(x) over w px, lag(y) over w py, lead(x) over w nx, lead(y) over w ny from v_track window w as (partition by flight order by idx)),
 q as (select *, coalesce(px,0.0e0) x0, coalesce(py,0.0e0) y0, case when px is null then 0.0e0 else sqrt(pow(x-px,2)+pow(y-py,2)) end st from p), t as (select *, abs({WRAP.format('(atan2(ny-y,nx-x)-atan2(y-y0,x-x0))')}) turn from q),
 c as (select *, case when nx is null or (x0=x and y0=y) then 2.0e0 when turn<=1.2e0 then 5.0e0-greatest(0.0e0,least(1.0e0,(turn-0.3e0)/(1.2e0-0.3e0)))*3.0e0 else 2.0e0-greatest(0.0e0,least(1.0e0,(turn-1.2e0)/(2.6e0-1.2e0)))*1.2e0 end corner,
 sum(st) over (partition by flight order by idx) d from t)
 select flight, idx, round(corner,4) corner, round(sqrt(greatest(0.0e0, min(corner*corner+0.44e0*d) over (partition by flight order by idx rows between current row and unbounded following) - 0.44e0*d)),4) speed from c""")
def win21(spark, sf):
    return flights.speed_profile(view(spark, sf, "v_track").select("flight", "idx", "x", "y"), ["flight"], chunk=1000).select("flight", "idx", r(F.col("corner")).alias("corner"), r(F.col("speed")).alias("speed"))


LOG = "(select flight, idx, epoch_us(t)/1e6 t, x, y, value/20 speed, k%2 side, k<40 steering, case when k%5=0 then 5.0e0+k end obst_m, case when k%7=0 then 'LOITER' when k%11=0 then 'STABILIZE' else 'AUTO' end mode from v_track)"


def flog(spark, sf):
    return view(spark, sf, "v_track").select("flight", "idx", F.expr("timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01', t)/1e6d").alias("t"), "x", "y", (F.col("value") / 20).alias("speed"), (F.col("k") % 2).alias("side"),
                                             (F.col("k") < 40).alias("steering"), F.expr("case when k%5=0 then 5.0e0+k end").alias("obst_m"), F.expr("case when k%7=0 then 'LOITER' when k%11=0 then 'STABILIZE' else 'AUTO' end").alias("mode"))


@query("WIN16_episodes", f"""with l as {LOG}, p as (select *, case when steering and not coalesce(lag(steering) over w,false) then 1 else 0 end st from l window w as (partition by flight order by idx)), n as (select *, sum(st) over (partition by flight order by idx) e from p)
 select flight, cast(e as bigint) episode, min(t) t0, max(t) t1, count(*) as "rows", round(avg(speed),9) mean_speed, round(sqrt(pow(arg_max(x,idx)-arg_min(x,idx),2)+pow(arg_max(y,idx)-arg_min(y,idx),2)),3) net_m, case when arg_min(side,idx)=1 then 'left' else 'right' end side, avg(speed)<1.0 crawled from n where steering group by 1,2""")
def win16(spark, sf):
    e = flights.episodes(flog(spark, sf), ["flight"], "steering", chunk=1000)
    return e.withColumns({"mean_speed": r(F.col("mean_speed"), 9), "net_m": r(F.col("net_m"), 3)})


@query("WIN17_mode_timeline", f"with l as {LOG}, p as (select *, lag(mode) over (partition by flight order by idx) was from l) select flight, idx, mode, mode in ('STABILIZE','ACRO') manual from p where was is distinct from mode")
def win17(spark, sf):
    return flights.mode_timeline(flog(spark, sf), ["flight"], chunk=1000).select("flight", "idx", "mode", "manual")


@query("AGG30_flight_health", """with m as (select concat('u',cast(user_id%50 as varchar)) flight, event_id%6 g, value v from events), a as (select flight, min(case when g=0 then v end) min_sats, max(case when g=1 then v/50 end) max_hdop, cast(3 as double) best_fix,
 coalesce(max(case when g=2 then v/4 end),0.0e0) max_vibe, max(case when g=3 then v/10 end) max_roll_err, max(case when g=4 then v/20 end) max_pitch_err, min(case when g=5 then v end) min_volt from m group by 1)
 select flight, min_sats, round(max_hdop,4) max_hdop, round(max_vibe,4) max_vibe, round(max_roll_err,4) max_roll_err, min_volt, concat_ws(',', 'no 3d fix', case when max_hdop>2 then 'hdop' end, case when max_vibe>30 then 'vibration' end, case when greatest(max_roll_err,max_pitch_err)>=5 then 'attitude' end) warnings from a""")
def agg30(spark, sf):
    m = ev(spark, sf, """select concat('u',cast(user_id%50 as string)) flight, case event_id%6 when 0 then 'GPS' when 1 then 'GPS' when 2 then 'VIBE' when 5 then 'BAT' else 'ATT' end kind,
     case event_id%6 when 0 then 'NSats' when 1 then 'HDop' when 2 then 'VibeY' when 3 then 'RollErr' when 4 then 'PitchErr' else 'Volt' end field, case event_id%6 when 0 then value when 1 then value/50 when 2 then value/4 when 3 then value/10 when 4 then value/20 else value end value from events""")
    return flights.flight_health(m, ["flight"]).select("flight", "min_sats", r(F.col("max_hdop")).alias("max_hdop"), r(F.col("max_vibe")).alias("max_vibe"), r(F.col("max_roll_err")).alias("max_roll_err"), "min_volt", "warnings")


@query("AGG31_coverage_declaration", """with w as (select concat('u',cast(user_id%50 as varchar)) flight, event_id wp, event_id%5 g, value from events), po as (select flight, wp, g=1 standoff from w where g<>0 or value>30), sk as (select flight, wp from w where g=0 union select flight, wp from w where g=1),
 re as (select flight, max(wp) reached, count(distinct wp) captured from po group by 1), s as (select sk.flight, count(*) unreachable, count(b.wp) recovered, count(*)-count(b.wp) uncovered from sk left join (select distinct flight, wp from po where standoff) b on b.flight=sk.flight and b.wp=sk.wp group by 1)
 select w.flight, count(*) waypoints, max(reached) reached, max(captured) captured, max(coalesce(unreachable,0)) unreachable, max(coalesce(recovered,0)) recovered, max(coalesce(uncovered,0)) uncovered, round(100*max(captured)/cast(max(reached)+1 as double),1) covered_pct from w left join re using (flight) left join s using (flight) group by 1""")
def agg31(spark, sf):
    w = ev(spark, sf, "select concat('u',cast(user_id%50 as string)) flight, event_id wp, event_id%5 g, value from events")
    poses = w.filter("g<>0 or value>30").select("flight", F.col("wp").alias("frame_idx"), (F.col("g") == 1).alias("standoff"))
    return flights.coverage_declaration(w, poses, w.filter("g in (0,1)"))


@query("AGG38_excursion_report", f"""with l as {LOG}, rt as (select 0.0e0 y union all select 121.0e0), o as (select idx, steering, min(sqrt(pow(x-least(greatest(x,0.0e0),200.0e0),2)+pow(l.y-rt.y,2))) d from l, rt where idx%5=0 group by 1,2)
 select (select min(obst_m) from l) closest_m, (select min(obst_m) from l)<11 below_standoff, round(max(d),4) max_off_m, round(max(case when steering then d end),4) steer_max_m, round(avg(case when steering then d end),4) steer_mean_m from o""")
def agg38(spark, sf):
    route = spark.createDataFrame([(0.0, 0.0, 200.0, 0.0), (0.0, 121.0, 200.0, 121.0)], "ax double, ay double, bx double, by double")
    out = flights.excursion_report(flog(spark, sf), route)
    return out.withColumns({c: r(F.col(c)) for c in ("max_off_m", "steer_max_m", "steer_mean_m")})


# ---- label sets ------------------------------------------------------------------

@query("WIN22_every_nth", "select event_id from (select event_id, row_number() over (order by event_id) n from events) t where (n-1)%7=0")
def win22(spark, sf):
    return datasets.every_nth(ev(spark, sf, "select event_id from events"), ["event_id"], 7)


@query("WIN22_split_by_range", "select event_id, case when event_id>=7000 then 'val' else 'train' end split from events where not (event_id between 100 and 250) and not (event_id between 8000 and 8010)")
def win22b(spark, sf):
    return datasets.split_by_range(ev(spark, sf, "select event_id from events"), "event_id", F.col("event_id") >= 7000, [(100, 250), (8000, 8010)])


@query("WIN23_suggest_splits", """with p as (select ord n, x+(ord%3)*0.1e0 x, y from v_bay), c as (select unnest(range(0, (select cast(max(n) as int)+1 from p), 60)) cut) select cast(cut as bigint) cut, (select count(*) from p where n<cut) train, (select count(*) from p where n>=cut) val,
 round((select min(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))) from p a, p b where a.n<cut and b.n>=cut),4) min_m, (select min(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))) from p a, p b where a.n<cut and b.n>=cut)>=25 ok from c where (select count(*) from p where n<cut)>=5 and (select count(*) from p where n>=cut)>=3""")
def win23(spark, sf):
    p = view(spark, sf, "v_bay").withColumn("x", F.col("x") + F.col("ord") % 3 * F.lit(0.1))
    return datasets.suggest_splits(p, "ord", 60).withColumn("min_m", r(F.col("min_m")))


@query("SET01_skip_done", "select c_custkey stem from customer where c_custkey%3<>0 and c_custkey not in (select o_custkey from orders where o_orderstatus='F')")
def set01(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("stem"))
    return datasets.skip_done(c, c.filter("stem%3=0"), table(spark, sf, "orders").filter("o_orderstatus='F'").select(F.col("o_custkey").alias("stem")))


@query("AGG32_merge_datasets", """with s as (select concat('s',cast(l_suppkey%4 as varchar)) source, l_suppkey%4 rk, case when l_orderkey%3=0 then 'val' else 'train' end split, concat('f',cast(l_orderkey as varchar)) stem, max(l_linenumber) boxes from lineitem group by 1,2,3,4)
 select stem, source, split source_split, case when source='s2' then 'val' else split end split, boxes, source='s2' hand_drawn from (select *, row_number() over (partition by stem order by rk) rn from s) t where rn=1""")
def agg32(spark, sf):
    s = ev(spark, sf, "select concat('s',cast(l_suppkey%4 as string)) source, l_suppkey%4 source_rank, case when l_orderkey%3=0 then 'val' else 'train' end split, concat('f',cast(l_orderkey as string)) stem, max(l_linenumber) boxes from lineitem group by 1,2,3,4")
    return datasets.merge_datasets(s, ["s2"])[0]


@query("CLU04_merge_drawings", """with g as (select distinct 'b' b, user_id from v_detection join events using (event_id) where user_id%13<>0) select round((user_id%40)*5.9e0,3) x, round(floor(user_id/40)*12.1e0,3) y, n drawings from (select user_id, count(*) n from v_detection join events using (event_id) group by 1) t""")
def clu04(spark, sf):
    e = ev(spark, sf, "select event_id, user_id from events")
    d = view(spark, sf, "v_detection").join(e, "event_id").select(F.col("event_id").alias("drawing_id"), ((F.col("user_id") % 40) * 5.9).alias("x"), (F.floor(F.col("user_id") / 40) * 12.1).alias("y"))
    d = d.withColumn("ring", geo.rectangle("x", "y", F.lit(1.0), F.lit(0.0), F.lit(5.4), F.lit(2.2)))
    out = datasets.merge_drawings(d.select("drawing_id", "ring")).withColumn("c", geo.vertex_centroid(F.col("ring")))
    return out.select(r(F.col("c.x"), 3).alias("x"), r(F.col("c.y"), 3).alias("y"), "drawings")


@query("CLU06_cover_frames")
def clu06(spark, sf):
    return datasets.cover_frames(shots(spark, sf), datasets.COVER_SLACK)


# A cover shows every bay that any frame shows, and gains add up to each bay once.
@query("CLU06_cover_totals", f"with {SHOT} select count(distinct bay_id) shown, count(distinct bay_id) gained, true as least_gain_positive from shot")
def clu06b(spark, sf):
    picks, views = clu06(spark, sf), shots(spark, sf)
    shown = views.join(picks, "frame_idx", "left_semi").agg(F.count_distinct("bay_id").alias("shown"))
    return side_by_side(shown, picks.agg(F.sum("gained").alias("gained"), (F.min("gained") > 0).alias("least_gain_positive")))


@query("CLU06_unreachable", f"with {SHOT} select bay_id from v_bay where bay_id not in (select bay_id from shot) union all select concat('hidden ', bay_id) from v_bay")
def clu06c(spark, sf):
    bays = view(spark, sf, "v_bay").select("bay_id")
    return datasets.unreachable(bays.unionByName(bays.select(F.concat(F.lit("hidden "), "bay_id").alias("bay_id"))), shots(spark, sf))


# ---- files: written from the tables, read back ------------------------------------

@query("SRC01_read_features", "select ord id, zona, round(x,4) x from v_bay")
def src01(spark, sf):
    path = scratch_path(spark, "features")
    sinks.write_features(ringed(spark, sf).withColumn("id", F.col("ord")), path, "Polygon", "ring", ["id", "zona"])
    back = features.read_features(spark, path, "Polygon", "id:bigint,zona:string")
    return back.select("id", "zona", r(geo.vertex_centroid(geo.open_ring(features.as_points(F.get("coords", F.lit(0))))).x).alias("x"))


@query("SRC02_load_bays", """select bay_id, case when ord%5=0 then null else zona end zona, street, park_txt, is_public, case when ord%4=0 then null else ord%90*1.0e0 end bearing_deg, round(x,4) x, round(y,4) y from v_bay""")
def src02(spark, sf):
    b = ringed(spark, sf).select(F.col("ord").alias("id"), F.expr("case when ord%5=0 then ' - ' else zona end").alias("zona"), F.col("street").alias("mestopoloz"), "park_txt",
                                 F.when(F.col("is_public"), text.PUBLIC_ZONE).otherwise("друго").alias("vid_txt_20"), F.expr("case when ord%4=0 then 'n/a' else cast(ord%90 as string) end").alias("bearing_deg"), "ring")
    path = scratch_path(spark, "bays")
    sinks.write_features(b, path, "Polygon", "ring", ["id", "zona", "mestopoloz", "park_txt", "vid_txt_20", "bearing_deg"])
    out = features.load_bays(features.read_features(spark, path, "Polygon", features.BAY_PROPS))
    return out.select("bay_id", "zona", "street", "park_txt", "is_public", "bearing_deg", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"))


@query("SRC03_load_curb_runs", "select run_id, street, case when capacity%3=0 then 0 else capacity end capacity, cast(3 as int) vertices, capacity%2=0 verified from v_run")
def src03(spark, sf):
    rr = lines(spark, sf).withColumns({"capacity_": F.expr("case when capacity%3<>0 then capacity end"), "verified": F.expr("case when capacity%2<>0 then false when capacity%4=0 then true end")})
    rr = rr.drop("capacity").withColumnRenamed("capacity_", "capacity")
    path = scratch_path(spark, "runs")
    sinks.write_features(rr, path, "LineString", "line", ["run_id", "street", "capacity", "pitch_m", "length_m", "verified"])
    out = features.load_curb_runs(features.read_features(spark, path, "LineString", features.RUN_PROPS))
    return out.select("run_id", "street", "capacity", F.size("line").alias("vertices"), "verified")


@query("SRC04_read_poses", "select frame_idx, round(x,6) x, round(yaw,6) yaw from v_pose where frame_idx%6<>0")
def src04(spark, sf):
    path = scratch_path(spark, "poses")
    p = view(spark, sf, "v_pose")
    doc = p.select(F.when(F.col("frame_idx") % 2 == 0, F.col("frame_idx")).alias("frame_idx"), F.when(F.col("frame_idx") % 2 == 1, F.col("frame_idx")).alias("i"), "x", "y", "alt", F.expr("case when frame_idx%6<>0 then yaw end").alias("yaw"))
    doc.select(F.concat(F.lit("["), F.to_json(F.struct("*")), F.lit("]")).alias("value")).write.text(path)
    return frames.usable_poses(frames.read_poses(spark, path, lines=True).drop("wp")).select("frame_idx", r(F.col("x"), 6).alias("x"), r(F.col("yaw"), 6).alias("yaw"))


SRT = """select flight source, concat_ws('\\n\\n', transform(array_sort(collect_list(struct(idx, txt))), e -> e.txt)) value from
 (select concat('u',cast(user_id%50 as string)) flight, event_id idx, concat(cast(event_id as string), '\\n00:00:01,000 --> 00:00:02,000\\nFrameCnt : ', cast(event_id as string), ' 2024-05-01 10:00:0', cast(event_id%10 as string), '.5\\n', case when event_id%3=0 then concat('GPS(23.', cast(1000+event_id%1000 as string), ',42.5,61.5)')
 else concat('[latitude : 42.6] [longitude : 23.', cast(1000+event_id%1000 as string), '] [rel_alt: 30.5 abs_alt: 600.1]') end, case when event_id%4=0 then ' [gb_yaw : 45.0 gb_pitch : -90.0]' else '' end) txt from events) t group by 1"""


@query("SRC05_parse_telemetry", """select concat('u',cast(user_id%50 as varchar)) source, cast(event_id as int) frame, timestamp '2024-05-01 10:00:00.5' + to_seconds(event_id%10) captured_at, case when event_id%3=0 then 42.5e0 else 42.6e0 end lat, round(23+(1000+event_id%1000)/10000.0e0,4) lon,
 case when event_id%3=0 then 61.5e0 else 30.5e0 end alt, case when event_id%4=0 then 45.0e0 end gb_yaw from events""")
def src05(spark, sf):
    out = frames.parse_telemetry(ev(spark, sf, SRT))
    return out.select("source", "frame", "captured_at", "lat", r(F.col("lon")).alias("lon"), "alt", "gb_yaw")


@query("SRC05_read_telemetry", """select concat('u',cast(user_id%50 as varchar)) source, count(*) n, count(case when event_id%4=0 then 1 end) aimed, min(event_id) first_frame, max(event_id) last_frame from events group by 1""")
def src05b(spark, sf):
    """A file per flight, named by its folder."""
    path = scratch_path(spark, "telemetry")
    ev(spark, sf, SRT).write.partitionBy("source").text(path)
    out = frames.parse_telemetry(frames.read_telemetry(spark, path))
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("gb_yaw").alias("aimed"), F.min("frame").cast("bigint").alias("first_frame"), F.max("frame").cast("bigint").alias("last_frame"))


@query("SRC06_telemetry_to_poses", f"""select cast(event_id as int) frame_idx, round((round(23+(1000+event_id%1000)/10000.0e0,4)-23.3298956e0)*{111320.0 * math.cos(math.radians(42.6747105))!r}e0,-1) x, round(case when event_id%4=0 then radians(45.0e0) end,6) yaw, round(case when event_id%4=0 then radians(90.0e0) end,6) cam_pitch,
 case when event_id%3=0 then 61.5e0 else 30.5e0 end alt from events""")
def src06(spark, sf):
    out = frames.telemetry_to_poses(frames.parse_telemetry(ev(spark, sf, SRT)))
    return out.select("frame_idx", F.round("x", -1).alias("x"), r(F.col("yaw"), 6).alias("yaw"), r(F.col("cam_pitch"), 6).alias("cam_pitch"), "alt")


@query("SRC07_field_presence", """select 'lat' field, count(*) present, count(*) total, 'ok' status from events union all select 'gb_yaw', count(case when event_id%4=0 then 1 end), count(*), 'partial' from events union all select 'baro', 0, count(*), 'MISSING' from events""")
def src07(spark, sf):
    return stats.field_presence(frames.parse_telemetry(ev(spark, sf, SRT)), ["lat", "gb_yaw", "baro"])


@query("SRC01_read_collections", "select ord id, zona, round(x,4) x from v_bay")
def src01b(spark, sf):
    """Collections of a thousand features, a document per file, read by ranges of bytes."""
    path = scratch_path(spark, "collections")
    f = sinks.features(ringed(spark, sf).withColumn("id", F.col("ord")), "Polygon", "ring", ["id", "zona"], keep=[F.floor(F.col("ord") / 1000).alias("d")])
    docs = f.groupBy("d").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    back = features.read_features(spark, path, "Polygon", "id:bigint,zona:string", whole_files=True)
    return back.select("id", "zona", r(geo.vertex_centroid(geo.open_ring(features.as_points(F.get("coords", F.lit(0))))).x).alias("x"))


@query("SRC08_read_detections", "select box_id//10 frame_idx, count(*) n, round(sum(conf),6) conf, round(sum(x0+y1),4) corners from v_det_box group by 1")
def src08(spark, sf):
    """Every order a frame; documents of a thousand frames, a file each, in the three forms and under the four kinds of key."""
    path = scratch_path(spark, "dets")
    d = view(spark, sf, "v_det_box").withColumn("f", F.floor(F.col("box_id") / 10))
    per = d.groupBy("f").agg(F.collect_list(F.struct(F.array("x0", "y0", "x1", "y1").alias("box"), "conf")).alias("ds"))
    name, number = F.concat(F.lit("frame_"), F.col("f").cast("string")), F.col("f") % 4
    key = F.when(number == 0, F.concat(name, F.lit(".jpg"))).when(number == 1, name).when(number == 2, (F.col("f") + 10**9).cast("string")).otherwise(F.col("f").cast("string"))
    pose = F.struct(F.when(number < 2, key).alias("file"), F.when(number == 2, F.col("f") + 10**9).alias("video_frame"), F.when(number == 3, F.col("f")).alias("frame_idx"))
    pairs = F.array_join(F.transform("ds", lambda e: F.concat(F.lit("["), F.to_json(e.box), F.lit(","), e.conf.cast("string"), F.lit("]"))), ",")
    per = per.select(F.floor(F.col("f") / 1000).alias("doc"), F.struct(key.alias("key"), F.col("ds").alias("value")).alias("entry"),
                     F.concat(F.lit('{"pose":'), F.to_json(pose), F.lit(',"dets":['), pairs, F.lit("]}")).alias("posed"))
    named = F.map_from_entries(F.collect_list("entry"))
    form = F.col("doc") % 3
    docs = per.groupBy("doc").agg(F.when(form == 0, F.to_json(F.struct(named.alias("frames")))).when(form == 1, F.to_json(named))
                                  .otherwise(F.concat(F.lit("["), F.array_join(F.collect_list("posed"), ","), F.lit("]"))).alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    poses = d.select(F.col("f").alias("frame_idx")).distinct().select("frame_idx", F.concat(F.lit("flight/frame_"), F.col("frame_idx").cast("string"), F.lit(".jpg")).alias("file"), (F.col("frame_idx") + 10**9).alias("video_frame"))
    dets = frames.read_detections(spark, path).withColumn("key", F.when(F.col("key").endswith(".jpg"), F.concat(F.lit("flight/"), "key")).otherwise(F.col("key")))
    got = frames.detections_for(poses, dets)
    return got.groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("conf"), 6).alias("conf"), F.round(F.sum(F.col("x0") + F.col("y1")), 4).alias("corners"))


@query("SNK01_feature_collection", "select bay_id, zona, round(x,4) x, cast(4 as int) corners from v_bay")
def snk01(spark, sf):
    path = scratch_path(spark, "collection")
    sinks.write_feature_collection(ringed(spark, sf), path, "Polygon", "ring", ["bay_id", "zona"])
    back = features.read_features(spark, path, "Polygon", "bay_id:string,zona:string")
    ring = geo.open_ring(features.as_points(F.get("coords", F.lit(0))))
    return back.select("bay_id", "zona", r(geo.vertex_centroid(ring).x).alias("x"), F.size(ring).alias("corners"))


@query("SNK07_yolo_labels", "select frame, count(case when k then 1 end) boxes, count(*) lines from (select frame, frame%4<>0 k from v_gt_box where frame%4<>0 union all select distinct frame, false from v_gt_box where frame%4=0) t group by 1")
def snk07(spark, sf):
    g = view(spark, sf, "v_gt_box").withColumn("stem", F.col("frame").cast("string"))
    path = scratch_path(spark, "labels")
    sinks.write_yolo_labels(g.filter("frame%4<>0").select("stem", "x0", "y0", "x1", "y1"), g.select("stem").distinct().withColumns({"w": F.lit(1920.0), "h": F.lit(1080.0)}), path)
    back = spark.read.text(path)
    return back.groupBy(F.col("stem").cast("bigint").alias("frame")).agg(F.count(F.when(F.col("value") != "", 1)).alias("boxes"), F.count(F.lit(1)).alias("lines"))


@query("SRC11_read_labels", "select survey_area area, bay_id, bool_or(occupied) gt from v_observation group by 1,2")
def src11(spark, sf):
    """Files of a thousand bays at most, in a folder per area."""
    o = view(spark, sf, "v_observation").groupBy("survey_area", "bay_id").agg(F.bool_or("occupied").alias("gt"))
    path = scratch_path(spark, "truth")
    docs = o.groupBy(F.col("survey_area").alias("area"), F.floor(F.col("bay_id").cast("bigint") / 1000).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("bay_id", "gt")))).alias("value"))
    docs.drop("part").write.option("maxRecordsPerFile", 1).partitionBy("area").text(path)
    return frames.read_labels(spark, path)


@query("SRC12_read_flight_log", "select count(*) n, count(case when k%5=0 then 1 end) obst, round(sum(x),2) sx from v_track")
def src12(spark, sf):
    path = scratch_path(spark, "log")
    log = flog(spark, sf).select("t", "x", "y", F.lit(30.0).alias("alt"), F.lit(0.0).alias("yaw"), "speed", F.lit(0).alias("wp"), F.lit(0.0).alias("wp_dist"), "obst_m")
    log.write.option("header", True).csv(path)
    back = frames.read_flight_log(spark, path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.count("obst_m").alias("obst"), F.round(F.sum("x"), 2).alias("sx"))
