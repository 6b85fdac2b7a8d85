"""Assignment, matching, audit and scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geo
from ..functions.geo import Camera
from ..operators import evaluate, evidence, intervals, reports, spatial, stats, vote
from ..session import cut
from .adapters import view
from .geometry_queries import FPX, ringed
from .kerb_queries import lines, segs
from .registry import query
from .state_queries import VOTED, voted

CAM = Camera()


def r(c, n=4):
    return F.round(c, n)


def one_box(spark, sf, name) -> DataFrame:
    """Boxes with the least corner per id, as ids repeat in the source; written once, as every score reads them several times."""
    v = view(spark, sf, name)
    return cut(v.groupBy("frame", "box_id").agg(*[F.min(c).alias(c) for c in ("x0", "y0", "x1", "y1")], *([F.min("conf").alias("conf")] if "conf" in v.columns else [])))


GT = "gt as (select frame, box_id, min(x0) x0, min(y0) y0, min(x1) x1, min(y1) y1 from v_gt_box group by 1,2)"
DT = "dt as (select frame, box_id, min(x0) x0, min(y0) y0, min(x1) x1, min(y1) y1, min(conf) conf from v_det_box group by 1,2)"
PAIRS = f"""{GT}, {DT}, pr as (select * from (select d.frame, d.box_id det, g.box_id gt, d.conf, greatest(0, least(g.x1,d.x1)-greatest(g.x0,d.x0))*greatest(0, least(g.y1,d.y1)-greatest(g.y0,d.y0)) i,
 (g.x1-g.x0)*(g.y1-g.y0)+(d.x1-d.x0)*(d.y1-d.y0) t from dt d join gt g on g.frame=d.frame) z where i/(t-i) >= 0.5e0)"""

NEAR_BAY = "(select d.event_id, b.bay_id, sqrt(pow(d.x-b.x,2)+pow(d.y-b.y,2)) dist, row_number() over (partition by d.event_id order by sqrt(pow(d.x-b.x,2)+pow(d.y-b.y,2)), b.bay_id) rn from v_detection d join v_bay b on abs(d.x-b.x)<=40 and abs(d.y-b.y)<=40)"


@query("JON04_nearest_bay", f"select event_id, bay_id, round(dist,6) dist from {NEAR_BAY} t where rn=1")
def jon04(spark, sf):
    out = spatial.nearest(view(spark, sf, "v_detection"), view(spark, sf, "v_bay"), "event_id", "bay_id", "x", "y", "x", "y", size=12.0)
    return out.withColumn("dist", r(F.col("dist"), 6))


HAV = "2*6371000.0e0*asin(sqrt(pow(sin(radians((b.lat-d.lat))/2),2)+cos(radians(d.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-d.lon)/2),2)))"


@query("JON05_nearest_free", f"""with fr as (select bay_id, 23.33e0+x*1.2e-5 lon, 42.67e0+y*9e-6 lat from v_bay left join v_state using (bay_id) where occupied = false),
 d as (select event_id, 23.33e0+x*1.2e-5 lon, 42.67e0+y*9e-6 lat from v_detection), q as (select event_id, {HAV} dist, row_number() over (partition by event_id order by {HAV}, bay_id) rn from d, fr b)
 select event_id, round(dist,3) dist from q where rn=1""")
def jon05(spark, sf):
    def ll(df):
        return df.withColumns({"lon": F.lit(23.33) + F.col("x") * 1.2e-5, "lat": F.lit(42.67) + F.col("y") * 9e-6})
    free = ll(view(spark, sf, "v_bay")).join(view(spark, sf, "v_state").filter("occupied = false").select("bay_id"), "bay_id")
    return spatial.nearest_geo(ll(view(spark, sf, "v_detection")), free, "event_id", "bay_id").select("event_id", r(F.col("dist"), 3).alias("dist"))


SHOT = f"""k as (select p.frame_idx, g.bay_id, g.x, g.y, {FPX}/30.0e0 f, g.x-p.x wx, g.y-p.y wy, g.l, g.w, g.c, g.s, sin(p.yaw) sy, cos(p.yaw) cy from v_pose p join v_ring g
  on g.x between p.x-30 and p.x+30 and g.y between p.y-30 and p.y+30),
 q as (select frame_idx, bay_id, x, y, 200.0e0+f*((wx+a*l/2*c-b*w/2*s)*sy-(wy+a*l/2*s+b*w/2*c)*cy) u, 120.0e0+f*(-(wx+a*l/2*c-b*w/2*s)*cy-(wy+a*l/2*s+b*w/2*c)*sy) v
  from k, (values (1,1),(1,-1),(-1,-1),(-1,1)) t(a,b)),
 shot as (select frame_idx, bay_id, x, y, sqrt(pow(avg(u)-200,2)+pow(avg(v)-120,2)) off, floor(min(u)) x0, floor(min(v)) y0, floor(max(u))+1 x1, floor(max(v))+1 y1 from q group by 1,2,3,4 having min(u)>=0 and max(u)<400 and min(v)>=0 and max(v)<240)"""


def shots(spark, sf) -> DataFrame:
    return cut(evidence.frame_bay_views(view(spark, sf, "v_pose"), ringed(spark, sf), CAM))


@query("JON06_frame_bay_views", f"with {SHOT} select frame_idx, bay_id, round(off,3) off from shot")
def jon06(spark, sf):
    return shots(spark, sf).select("frame_idx", "bay_id", r(F.col("off"), 3).alias("off"))


DET = "d as (select event_id, cast(cast(user_id as int) + (event_id%3) as int) frame_idx, x, y, conf from v_detection join events using (event_id))"


def dets(spark, sf) -> DataFrame:
    """Detections filed under frames taken near them."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", (F.col("user_id").cast("int") + F.col("event_id") % 3).cast("int").alias("frame_idx"))
    return view(spark, sf, "v_detection").select("event_id", "x", "y", "conf").join(e, "event_id")


RANGE = f"{SHOT}, {DET}, rg as (select d.event_id, s.frame_idx, s.bay_id, d.conf, sqrt(pow(d.x-s.x,2)+pow(d.y-s.y,2)) dist from d join shot s using (frame_idx) where pow(d.x-s.x,2)+pow(d.y-s.y,2) <= 9.0e0)"


@query("JON07_assign_inclusive", f"with {RANGE} select s.frame_idx, s.bay_id, max(conf) is not null occupied, max(conf) det_score from shot s left join rg using (frame_idx, bay_id) group by 1,2")
def jon07(spark, sf):
    return evidence.assign_inclusive(dets(spark, sf), shots(spark, sf)).drop("off")


OWN = "own as (select * from (select *, row_number() over (partition by event_id order by dist, bay_id) rn from rg) t where rn=1)"


@query("JON08_assign_nearest", f"with {RANGE}, {OWN} select s.frame_idx, s.bay_id, max(conf) is not null occupied, max(conf) det_score from shot s left join own using (frame_idx, bay_id) group by 1,2")
def jon08(spark, sf):
    return evidence.assign_nearest(dets(spark, sf), shots(spark, sf)).drop("off")


UNASS = f"un as (select d.*, n.bay_id nearest_bay, n.dist nearest_m from d join {NEAR_BAY} n on n.event_id=d.event_id and n.rn=1 where d.event_id not in (select event_id from rg))"


def rejected(spark, sf):
    return evidence.unassigned(dets(spark, sf), shots(spark, sf), view(spark, sf, "v_bay"))


@query("JON09_unassigned", f"with {RANGE}, {UNASS} select event_id, nearest_bay, round(nearest_m,6) nearest_m from un")
def jon09(spark, sf):
    return rejected(spark, sf).select("event_id", "nearest_bay", r(F.col("nearest_m"), 6).alias("nearest_m"))


@query("AGG36_unassigned_report", f"""with {RANGE}, {UNASS}, kk as (select *, row_number() over (order by nearest_m) - 1 i, count(*) over () n from un)
 select (select count(*) from d) detections, count(*) unmatched, count(case when nearest_m<=6 then 1 end) within_2r, count(case when nearest_m<=3 then 1 end) within_3m, count(case when nearest_m<=5 then 1 end) within_5m,
 count(case when exists (select 1 from v_ring g where abs((kk.x-g.x)*g.c+(kk.y-g.y)*g.s) < g.l/2 and abs((kk.y-g.y)*g.c-(kk.x-g.x)*g.s) < g.w/2) then 1 end) inside,
 round(max(case when i=floor(n*0.1e0) then nearest_m end),4) nearest_p10, round(max(case when i=floor(n*0.5e0) then nearest_m end),4) nearest_p50, round(max(case when i=floor(n*0.9e0) then nearest_m end),4) nearest_p90,
 round(count(*)/cast((select count(*) from d) as double),4) unmatched_share from kk""")
def agg36(spark, sf):
    # detections are read by four parts, outlines by two
    found, outlines = cut(dets(spark, sf)), cut(ringed(spark, sf))
    views = cut(evidence.frame_bay_views(view(spark, sf, "v_pose"), outlines, CAM))
    out = reports.unassigned_report(found, evidence.unassigned(found, views, view(spark, sf, "v_bay")), outlines)
    return out.withColumns({c: r(F.col(c)) for c in ("nearest_p10", "nearest_p50", "nearest_p90")})


# the bays' own outlines against centre lines that leave some streets unnamed
ROADD = """rd as (select b.bay_id, b.street, s.name, s.by_, s.ay, sqrt(dd) d, oy, ox, row_number() over (partition by b.bay_id order by case when s.name is not null and (contains(s.name,b.street) or contains(b.street,s.name)) then 0 else 1 end, dd, name) rn
 from v_bay b join (select *, 260.0e0 dx, by_-ay dy from v_road) s on abs(b.y-s.ay)<=41, lateral (select greatest(0.0e0,least(1.0e0,((b.x-s.ax)*s.dx+(b.y-s.ay)*s.dy)/(s.dx*s.dx+s.dy*s.dy))) t) q,
 lateral (select b.x-s.ax-q.t*s.dx ox, b.y-s.ay-q.t*s.dy oy) o, lateral (select o.ox*o.ox+o.oy*o.oy dd) z where dd<=1600.0e0)"""


def roads(spark, sf):
    return view(spark, sf, "v_road").withColumnRenamed("by_", "by")


@query("JON12_nearest_road", f"with {ROADD} select bay_id, round(d,4) dist, round(degrees(atan2(by_-ay, 260.0e0)),4) bearing_deg, name from rd where rn=1")
def jon12(spark, sf):
    out = spatial.nearest_road(view(spark, sf, "v_bay"), roads(spark, sf))
    return out.select("bay_id", r(F.col("dist")).alias("dist"), r(F.col("bearing_deg")).alias("bearing_deg"), "name")


@query("JON13_row_side", f"with {ROADD} select bay_id, concat(street, ' - ', case when abs(oy)>=abs(ox) then case when oy>0 then 'N' else 'S' end else case when ox>0 then 'E' else 'W' end end) label from rd where rn=1")
def jon13(spark, sf):
    return spatial.row_side(view(spark, sf, "v_bay"), roads(spark, sf))


# Beside the bays: copies far from every road, those of a street together, and copies that are alone in their street.
STRAY = """select bay_id, street, x, y from v_bay union all
 select concat('far ', bay_id), concat('far ', street), x+(ord*ord%13)*0.21e0, y+1000.0e0+x*0.5e0+(ord*ord%17)*0.13e0 from v_bay union all
 select concat('lone ', bay_id), concat('lone ', bay_id), x+(ord*ord%13)*0.21e0, y+900000.0e0+x*0.7e0+(ord*ord%17)*0.13e0 from v_bay"""


@query("JON12_street_bearing", f"""with {ROADD}, st as ({STRAY}), far as (select * from st where bay_id like 'far %'), lone as (select * from st where bay_id like 'lone %'),
 six as (select a.bay_id, b.x, b.y from far a join far b on a.street=b.street qualify row_number() over (partition by a.bay_id order by sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)), b.bay_id) <= 6),
 ax as (select bay_id, degrees(atan2(2*covar_pop(x,y), var_pop(x)-var_pop(y))/2) d from six group by 1 having count(*)>=3),
 rest as (select * from lone union all select * from far where bay_id not in (select bay_id from ax)),
 tw as (select a.bay_id, degrees(atan2(b.y-a.y, b.x-a.x)) d from rest a join st b on a.bay_id<>b.bay_id qualify row_number() over (partition by a.bay_id order by sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)), b.bay_id) = 1),
 al as (select bay_id, degrees(atan2(by_-ay, 260.0e0)) d from rd where rn=1 union all select * from ax union all select * from tw)
 select bay_id, round(d-180*floor(d/180),3) bearing_deg from al""")
def jon12b(spark, sf):
    bays = view(spark, sf, "v_bay")
    bays.createOrReplaceTempView("stray_bays")
    out = spatial.street_bearing(spark.sql(STRAY.replace("v_bay", "stray_bays")), roads(spark, sf))
    return out.select("bay_id", r(F.col("bearing_deg"), 3).alias("bearing_deg"))


# The detections of all frames step by step, each frame with the list of the boxes it has given away.
@query("JON14_match_boxes_greedy", f"""with recursive {PAIRS}, gk as (select frame, box_id, min(box_id) over (partition by frame, x0, y0, x1, y1) kind from gt), tn as (select frame, box_id, row_number() over (partition by frame order by conf desc, box_id) k from dt),
 w as (select pr.frame, tn.k, pr.gt, gk.kind, i/(t-i) v from pr join tn on tn.frame=pr.frame and tn.box_id=pr.det join gk on gk.frame=pr.frame and gk.box_id=pr.gt),
 st as (select frame, cast(0 as bigint) k, cast([] as bigint[]) used from (select distinct frame from dt) f union all
  select st.frame, st.k+1, case when count(w.gt)=0 then any_value(used) else list_append(any_value(used), arg_min(w.gt, row(-w.v, w.kind, w.gt))) end
  from st left join w on w.frame=st.frame and w.k=st.k+1 and not list_contains(used, w.gt) where st.k < (select max(k) from tn) group by st.frame, st.k),
 n as (select cast((select sum(len(used)) from st where k=(select max(k) from tn)) as bigint) tp, (select count(*) from dt) d, (select count(*) from gt) g)
 select tp, d-tp fp, g-tp fn, round(tp/cast(d as double),4) "precision", round(tp/cast(g as double),4) recall from n""")
def jon14(spark, sf):
    d, g = one_box(spark, sf, "v_det_box"), one_box(spark, sf, "v_gt_box")
    return evaluate.greedy_score(d, g, evaluate.match_boxes_greedy(d, g))


@query("JON15_match_boxes_any", f"""with {PAIRS}, lf as (select distinct frame from gt where frame%5<>0), h as (select count(distinct gt) h from pr where frame%5<>0), m as (select count(*) m from dt where frame%5<>0 and frame in (select frame from lf)),
 g as (select count(*) g from gt where frame%5<>0) select 'any' classes, h hits, g truth, m made, round(h/nullif(cast(g as double),0),4) recall, round(h/nullif(cast(m as double),0),4) "precision" from h,m,g""")
def jon15(spark, sf):
    d, g = one_box(spark, sf, "v_det_box"), one_box(spark, sf, "v_gt_box")
    return evaluate.match_boxes_any(d, g, g.filter("frame%5<>0"))


@query("AGG16_conf_sweep", f"""with {PAIRS}, b as (select frame, gt, max(conf) conf from pr group by 1,2), t(c) as (values (0.5e0),(0.6e0),(0.8e0),(0.9e0))
 select c conf, (select count(*) from b where conf>=c) hits, (select count(*) from dt where conf>=c) made, (select count(*) from gt) truth,
 round((select count(*) from b where conf>=c)/nullif(cast((select count(*) from dt where conf>=c) as double),0),4) "precision", round((select count(*) from b where conf>=c)/cast((select count(*) from gt) as double),4) recall from t""")
def agg16(spark, sf):
    return evaluate.conf_sweep(one_box(spark, sf, "v_det_box"), one_box(spark, sf, "v_gt_box"), [0.5, 0.6, 0.8, 0.9])


@query("AGG37_correction_stats", f"""with {PAIRS}, a as (select case when g.frame%4=0 then 'val' else 'train' end split, g.frame, g.box_id, max(i/(t-i)) v from gt g left join pr on pr.frame=g.frame and pr.gt=g.box_id group by 1,2,3),
 b as (select case when d.frame%4=0 then 'val' else 'train' end split, d.frame, d.box_id, count(pr.gt) k from dt d left join pr on pr.frame=d.frame and pr.det=d.box_id group by 1,2,3),
 f as (select split, count(distinct frame) frames from (select split, frame from a union all select split, frame from b) t group by 1),
 x as (select split, count(*) cars, count(v) kept, count(case when v<0.85e0 then 1 end) nudged, count(*)-count(v) drawn from a group by 1), y as (select split, count(*) predicted, count(case when k=0 then 1 end) deleted from b group by 1)
 select *, round((drawn+deleted)/cast(frames as double),3) edits_per_frame, round((predicted-deleted)/cast(predicted as double),4) "precision", round(kept/cast(cars as double),4) recall from f join x using (split) join y using (split)""")
def agg37(spark, sf):
    split = F.when(F.col("frame") % 4 == 0, "val").otherwise("train")
    return evaluate.correction_stats(one_box(spark, sf, "v_det_box").withColumn("split", split), one_box(spark, sf, "v_gt_box").withColumn("split", split))


# The boxes of all frames step by step, each frame with the list of those it keeps.
@query("UDF04_nms", f"""with recursive {DT}, tn as (select *, row_number() over (partition by frame order by conf desc, box_id) k from dt),
 cp as (select frame, k, hi from (select a.frame, a.k, b.box_id hi, greatest(0, least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0, least(a.y1,b.y1)-greatest(a.y0,b.y0)) i,
  (a.x1-a.x0)*(a.y1-a.y0)+(b.x1-b.x0)*(b.y1-b.y0) t from tn a join tn b on a.frame=b.frame and b.k<a.k) z where i/(t-i) > 0.4e0),
 st as (select frame, cast(0 as bigint) k, cast([] as bigint[]) kept from (select distinct frame from dt) f union all
  select st.frame, st.k+1, case when count(cp.hi)=0 then list_append(any_value(kept), any_value(tn.box_id)) else any_value(kept) end
  from st join tn on tn.frame=st.frame and tn.k=st.k+1 left join cp on cp.frame=st.frame and cp.k=st.k+1 and list_contains(kept, cp.hi) group by st.frame, st.k),
 ids as (select frame, unnest(kept) box_id from (select frame, arg_max(kept, k) kept from st group by frame) t) select frame, box_id, conf from ids join dt using (frame, box_id)""")
def udf04(spark, sf):
    return evaluate.nms(one_box(spark, sf, "v_det_box"), 0.4).select("frame", "box_id", "conf")


@query("UDF04_tile_grid", """with f as (select distinct frame from v_gt_box), t as (select frame, 1280+frame%3*10 w, 960 h from f), s as (select *, cast(floor(w/2.6e0) as int) tw, cast(floor(h/2.6e0) as int) th from t),
 u as (select *, cast(floor(tw*0.8e0) as int) sx, cast(floor(th*0.8e0) as int) sy from s), g as (select u.*, cast(i as int) i, cast(j as int) j from u, (select unnest([0,1,2]) i) a, (select unnest([0,1,2]) j) b)
 select frame, i, j, cast(least(i*sx, w-tw) as int) x0, cast(least(j*sy, h-th) as int) y0, cast(least(i*sx, w-tw)+tw as int) x1, cast(least(j*sy,h-th)+th as int) y1 from g""")
def udf04b(spark, sf):
    f = view(spark, sf, "v_gt_box").select("frame").distinct().select("frame", (F.lit(1280) + F.col("frame") % 3 * 10).cast("int").alias("w"), F.lit(960).alias("h"))
    return evaluate.tile_grid(f, 3)


@query("JON16_match_drawings")
def jon16(spark, sf):
    d = view(spark, sf, "v_detection").select(F.col("event_id").alias("drawing_id"), (F.col("event_id") % 7).alias("votes"), "x", "y")
    got, rest = evaluate.match_drawings(d, view(spark, sf, "v_bay"))
    return got.select("drawing_id", "bay_id", r(F.col("dist")).alias("dist")).unionByName(rest.select("drawing_id", F.lit(None).cast("string").alias("bay_id"), r(F.col("nearest_m")).alias("dist")))


MATED = """with a as (select g.*, g.x+1.1e0 ax, g.y+(ord%5)*0.3e0 ay from v_ring g), d as (select a.bay_id, b.bay_id other_id, sqrt(pow(ax-b.x,2)+pow(ay-b.y,2)) dist, ax-b.x dx, ay-b.y dy, a.c, a.s,
 row_number() over (partition by a.bay_id order by sqrt(pow(ax-b.x,2)+pow(ay-b.y,2)), b.bay_id) rn from a join v_bay b on abs(ax-b.x)<=6 and abs(ay-b.y)<=6)
 select bay_id, other_id, round(dist,4) dist, round(abs(dx*c+dy*s),4) along_m, round(abs(dy*c-dx*s),4) across_m, bay_id=other_id same_id from d where rn=1 and dist<=6"""


@query("JON17_pair_by_position", MATED)
def jon17(spark, sf):
    a = ringed(spark, sf).withColumns({"x": F.col("x") + 1.1, "y": F.col("y") + F.col("ord") % 5 * F.lit(0.3)})
    out = reports.pair_by_position(a, view(spark, sf, "v_bay").withColumnRenamed("bay_id", "other_id"))
    return out.withColumns({c: r(F.col(c)) for c in ("dist", "along_m", "across_m")})


@query("JON17_pair_agreement", f"""with p as ({MATED}), k as (select *, row_number() over (order by along_m) - 1 i, row_number() over (order by across_m) - 1 j, count(*) over () n from p)
 select max(n) pairs, count(case when same_id then 1 end) same_id, max(case when i=round_even((n-1)*0.5e0,0) then along_m end) along_m_p50, max(case when i=round_even((n-1)*0.9e0,0) then along_m end) along_m_p90,
 max(case when j=round_even((n-1)*0.5e0,0) then across_m end) across_m_p50, max(case when j=round_even((n-1)*0.9e0,0) then across_m end) across_m_p90 from k""")
def jon17b(spark, sf):
    return reports.pair_agreement(jon17(spark, sf))


@query("JON18_overlapping_bays", """select a.bay_id a, b.bay_id b from v_bay a join v_bay b on a.ord<b.ord and abs(a.x-b.x)<3.0e0+(b.ord%4)*1.0e0+(a.ord%4)*1.0e0 and abs(a.y-b.y)<2.2e0+(b.ord%3)*4.0e0+(a.ord%3)*4.0e0""")
def jon18(spark, sf):
    b = view(spark, sf, "v_bay").withColumn("ring", geo.rectangle("x", "y", F.lit(1.0), F.lit(0.0), F.col("ord") % 4 * 2.0 + 3.0, F.col("ord") % 3 * 8.0 + 2.2))
    return spatial.overlapping(b)


@query("JON20_airspace_conflicts", """with z(id, restriction, x0, y0, x1, y1) as (values ('z1','PROHIBITED',10.0e0,-5.0e0,70.0e0,40.0e0),('z2','REQ_AUTHORISATION',40.0e0,20.0e0,200.0e0,100.0e0)),
 h as (select p.event_id, z.* from v_detection p join z on p.x between x0 and x1 and p.y between y0 and y1) select restriction, count(*) hits, count(distinct event_id) points from h group by 1""")
def jon20(spark, sf):
    rows = [("z1", "PROHIBITED", 10.0, -5.0, 70.0, 40.0), ("z2", "REQ_AUTHORISATION", 40.0, 20.0, 200.0, 100.0)]
    z = spark.createDataFrame(rows, "identifier string, restriction string, x0 double, y0 double, x1 double, y1 double")
    z = z.withColumn("ring", F.array(*[geo.point(a, b) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])).withColumns({"lower_m": F.lit(0.0), "upper_m": F.lit(120.0)})
    hits = spatial.airspace_conflicts(view(spark, sf, "v_detection").select("event_id", "x", "y"), z, "x", "y", 30.0)
    return hits.groupBy("restriction").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("event_id").alias("points"))


@query("JON19_route_hazards", """select osm_id, round(top,1) height_m, round(dist,1) min_route_dist_m from (select bay_id osm_id, 20.0e0+ord%15 top, greatest(0.0e0, abs(y-100.0e0)-1.0e0) dist from v_bay where x between 2 and 198) t where top+5>30 and dist<=10
 union all select bay_id, round(20.0e0+ord%15,1), round(sqrt(pow(greatest(0.0e0, case when x<0 then 0 when x>198 then x-2.0e0-200.0e0 else -2.0e0-x+0 end),2)+pow(greatest(0.0e0,abs(y-100.0e0)-1.0e0),2)),1) from v_bay where (x<2 or x>198) and 25.0e0+ord%15>30
 and sqrt(pow(greatest(0.0e0, case when x<2 then -2.0e0-x else x-202.0e0 end),2)+pow(greatest(0.0e0,abs(y-100.0e0)-1.0e0),2))<=10""")
def jon19(spark, sf):
    b = view(spark, sf, "v_bay").select(F.col("bay_id").alias("osm_id"), (F.lit(20.0) + F.col("ord") % 15).alias("top"),
                                        geo.rectangle("x", "y", F.lit(1.0), F.lit(0.0), F.lit(4.0), F.lit(2.0)).alias("ring"))
    route = spark.range(10).select((F.col("id") * 20.0).alias("ax"), F.lit(100.0).alias("ay"), (F.col("id") * 20.0 + 20.0).alias("bx"), F.lit(100.0).alias("by"))
    return spatial.route_hazards(b, route)


@query("JON22_best_view", f"with {SHOT} select bay_id, frame_idx, round(off,3) off from (select *, row_number() over (partition by bay_id order by off, frame_idx) rn from shot) t where rn=1")
def jon22(spark, sf):
    return evidence.best_view(shots(spark, sf)).withColumn("off", r(F.col("off"), 3))


@query("JON23_min_separation", """with a as (select x, y from v_bay where floor(ord/40)<10), b as (select x, y from v_bay where floor(ord/40)>=10) select round(min(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))),4) min_m from a, b""")
def jon23(spark, sf):
    b = view(spark, sf, "v_bay").withColumn("row", F.floor(F.col("ord") / 40))
    return spatial.min_separation(b.filter("row<10"), b.filter("row>=10")).select(r(F.col("min_m")).alias("min_m"))


@query("JON23_buffer_exclude", """select a.bay_id from v_bay a where floor(ord/40)<10 and not exists (select 1 from v_bay b where floor(b.ord/40)>=10 and pow(a.x-b.x,2)+pow(a.y-b.y,2) < 625.0e0)""")
def jon23b(spark, sf):
    b = view(spark, sf, "v_bay").withColumn("row", F.floor(F.col("ord") / 40))
    return spatial.buffer_exclude(b.filter("row<10"), b.filter("row>=10"), "bay_id", 25.0).select("bay_id")


@query("JON24_offroute_distance", """select event_id, round(min(sqrt(pow(d.x-least(greatest(d.x,0.0e0),length_m),2)+pow(d.y-r.y,2))),4) dist from v_detection d, (select * from v_run where run_id in ('run_1','run_3')) r group by 1""")
def jon24(spark, sf):
    s = segs(spark, sf).filter(F.col("run_id").isin("run_1", "run_3"))
    return spatial.off_route(view(spark, sf, "v_detection"), s, "event_id", "x", "y").select("event_id", r(F.col("dist")).alias("dist"))


@query("JON27_crop_windows", f"with {SHOT} select frame_idx, bay_id, cast(x0 as int) x0, cast(y0 as int) y0, cast(x1 as int) x1, cast(y1 as int) y1, case when occupied then 'occupied' else 'free' end label from shot join (select bay_id, occupied from v_state where occupied is not null) s using (bay_id)")
def jon27(spark, sf):
    return evidence.crop_windows(shots(spark, sf), view(spark, sf, "v_state").filter("occupied is not null"))


@query("JON28_pair_stills_poses", """with s as (select event_id idx from events where event_id>=120 and event_id<8000 and (event_id-120)%15=0), p as (select event_id video_frame, value from events where event_id%2=0) select idx, value from s left join p on idx+1=video_frame""")
def jon28(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return evidence.pair_stills_poses(e.select(F.col("event_id").alias("idx")), e.filter("event_id%2=0").select(F.col("event_id").alias("video_frame"), "value"), 29.97, 2.0, 120, 8000)


# ---- scores -------------------------------------------------------------------

LABELS = "lb as (select bay_id, case when cast(bay_id as int)%6=0 then null else cast(bay_id as int)%3=0 end gt from v_bay)"


def labels(spark, sf):
    return view(spark, sf, "v_bay").select("bay_id", F.expr("case when ord%6=0 then null else ord%3=0 end").alias("gt"))


@query("AGG14_confusion", f"""with {VOTED}, {LABELS}, j as (select l.*, v.occupied from lb l left join voted v using (bay_id) where gt is not null and cast(bay_id as int)%17<>0),
 c as (select count(case when occupied and gt then 1 end) tp, count(case when not occupied and not gt then 1 end) tn, count(case when occupied and not gt then 1 end) fp, count(case when not occupied and gt then 1 end) fn, count(case when occupied is null then 1 end) unseen from j)
 select *, round((tp+tn)/nullif(cast(tp+tn+fp+fn as double),0),4) accuracy, round(tp/nullif(cast(tp+fp as double),0),4) "precision", round(tp/nullif(cast(tp+fn as double),0),4) recall from c""")
def agg14(spark, sf):
    return stats.confusion(voted(spark, sf), labels(spark, sf), view(spark, sf, "v_bay").filter("ord%17=0"))


SWEEP = f"""with {RANGE.replace('<= 9.0e0', '<= 16.0e0')}, {OWN}, {LABELS}, na as (select frame_idx, bay_id, min(dist) m from rg group by 1,2), no as (select frame_idx, bay_id, min(dist) m from own group by 1,2),
 t(radius) as (values (1.0e0),(2.0e0),(4.0e0)), e as (select s.bay_id, radius, 'inclusive' as rule, coalesce(na.m<=radius,false) hit from shot s left join na using (frame_idx,bay_id), t union all select s.bay_id, radius, 'nearest', coalesce(no.m<=radius,false) from shot s left join no using (frame_idx,bay_id), t),
 v as (select bay_id, radius, rule, count(case when hit then 1 end)*2>count(*) occupied from e group by 1,2,3), j as (select v.*, gt from v join lb using (bay_id) where gt is not null),
 c as (select radius, rule, count(case when occupied and gt then 1 end) tp, count(case when not occupied and not gt then 1 end) tn, count(case when occupied and not gt then 1 end) fp, count(case when not occupied and gt then 1 end) fn from j group by 1,2)
 select *, round((tp+tn)/nullif(cast(tp+tn+fp+fn as double),0),4) accuracy, round(tp/nullif(cast(tp+fp as double),0),4) "precision", round(tp/nullif(cast(tp+fn as double),0),4) recall from c"""


@query("AGG15_radius_sweep", SWEEP)
def agg15(spark, sf):
    return evaluate.radius_sweep(dets(spark, sf), shots(spark, sf), labels(spark, sf), [1.0, 2.0, 4.0])


@query("AGG15_best_setting", SWEEP + " order by accuracy desc, radius, rule limit 1")
def agg15b(spark, sf):
    return evaluate.best_setting(agg15(spark, sf))


@query("AGG17_count_errors", """with s as (select run_id, cast(floor(s0/18) as int) seg, count(*) pred, count(distinct frame_idx)-1 gt from v_span group by 1,2) select count(*) segments, cast(sum(pred) as bigint) predicted, cast(sum(gt) as bigint) counted, round(avg(abs(pred-gt)),3) mae, round(avg(pred-gt),3) bias, count(case when abs(pred-gt)<=1 then 1 end) within_1 from s""")
def agg17(spark, sf):
    s = view(spark, sf, "v_span").groupBy("run_id", F.floor(F.col("s0") / 18).alias("seg")).agg(F.count(F.lit(1)).alias("pred"), (F.count_distinct("frame_idx") - 1).alias("gt"))
    return stats.count_errors(s, "pred", "gt")


@query("AGG18_plausibility_gate", """with s as (select event_id, run_id, s0, s1, case when event_id%7=0 then null else event_id%5 end "count", event_id%11=0 skip from v_span), r as (select run_id, case when cast(substr(run_id,5) as int)%2=0 then 'perpendicular' else 'parallel' end park_txt from v_run)
 select event_id, coalesce("count">0 and (s1-s0)/nullif("count",0) < case when park_txt='perpendicular' then 2.2e0 else 4.0e0 end and park_txt is not null, false) dropped from s left join r using (run_id) where not skip and "count" is not null""")
def agg18(spark, sf):
    s = view(spark, sf, "v_span").select("event_id", "run_id", "s0", "s1", F.expr("case when event_id%7=0 then null else event_id%5 end").alias("count"), F.expr("event_id%11=0").alias("skip"))
    rr = view(spark, sf, "v_run").select("run_id", F.expr("case when cast(substr(run_id,5) as int)%2=0 then 'Напречно' else 'Надлъжно' end").alias("park_txt"))
    kept, dropped = intervals.plausibility_gate(s, rr)
    return kept.select("event_id", F.lit(False).alias("dropped")).unionByName(dropped.select("event_id", F.lit(True).alias("dropped")))


def buildings(spark, sf):
    b = view(spark, sf, "v_bay").filter("ord%50 < 3")
    return b.select(F.col("bay_id").alias("osm_id"), geo.rectangle(F.col("x") + 1.0, F.col("y") + 1.5, F.lit(1.0), F.lit(0.0), F.lit(9.0), F.lit(5.0)).alias("ring"))


AUDIT = """with a as (select b.bay_id, b.street, b.park_txt, s.name, sqrt(dd) d, degrees(atan2(s.by_-s.ay,260.0e0)) brg, b.deg + case b.park_txt when 'perpendicular' then 90.0e0 when 'angled' then 45.0e0 else 0.0e0 end ax, b.x, b.y,
 row_number() over (partition by b.bay_id order by dd) rn from v_ring b join (select *, 260.0e0 dx, by_-ay dy from v_road) s on abs(b.y-s.ay)<=30, lateral (select greatest(0.0e0,least(1.0e0,((b.x-s.ax)*s.dx+(b.y-s.ay)*s.dy)/(s.dx*s.dx+s.dy*s.dy))) t) q,
 lateral (select pow(b.x-s.ax-q.t*s.dx,2)+pow(b.y-s.ay-q.t*s.dy,2) dd) z),
 f as (select *, least(abs(ax-brg)%180, 180-abs(ax-brg)%180) df from a where rn=1), g as (select *, case when park_txt='parallel' then df else 90-df end sk, exists (select 1 from v_bay h where h.ord%50<3 and abs(f.x-h.x-1)<4.5 and abs(f.y-h.y-1.5)<2.5) inb from f)
 select bay_id, round(d,2) road_m, round(sk,1) skew_deg, inb in_building, coalesce(name=street,false) name_ok, inb or round(d,2)>15 or round(sk,1)>25 flagged from g"""


@query("AGG20_bay_audit", AUDIT)
def agg20(spark, sf):
    return audit(spark, sf).select("bay_id", "road_m", "skew_deg", "in_building", F.coalesce("name_ok", F.lit(False)).alias("name_ok"), "flagged")


def audit(spark, sf):
    return reports.bay_audit(ringed(spark, sf), roads(spark, sf), buildings(spark, sf))


@query("AGG21_audit_report", f"""with z as (select q.*, v.street from ({AUDIT}) q join v_bay v using (bay_id)), g as (select street, count(*) bays, count(case when in_building then 1 end) in_building, count(case when flagged then 1 end) flagged,
 list_sort(list(road_m)) r, list_sort(list(skew_deg)) s from z group by 1 having count(*)>=10)
select street, bays, in_building, flagged, r[cast(round_even((bays-1)*0.5,0) as int)+1] road_p50, r[cast(round_even((bays-1)*0.9,0) as int)+1] road_p90, s[cast(round_even((bays-1)*0.5,0) as int)+1] skew_p50, flagged/bays flag_share from g""")
def agg21(spark, sf):
    return reports.audit_report(audit(spark, sf))


@query("AGG21_distance_histogram", f"select cast(least(floor(road_m/5.0e0),7) as int) bin, count(*) bays from ({AUDIT}) q group by 1")
def agg21b(spark, sf):
    return reports.distance_histogram(audit(spark, sf))


@query("AGG22_linear_fit", """with t as (select value y, cast(event_id as double) a, (event_id%24)*1.0e0+value/10 b from events) select 'a' covariate, count(*) n, round(regr_slope(y,a),6) slope, round(regr_intercept(y,a),6) intercept, round(regr_r2(y,a),6) r2 from t
 union all select 'b', count(*), round(regr_slope(y,b),6), round(regr_intercept(y,b),6), round(regr_r2(y,b),6) from t""")
def agg22(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("value").alias("y"), F.col("event_id").cast("double").alias("a"), (F.col("event_id") % 24 + F.col("value") / 10).alias("b"), F.lit(3.0).alias("flat"))
    return stats.linear_fit(e, ["a", "b", "flat"], "y").withColumns({c: r(F.col(c), 6) for c in ("slope", "intercept", "r2")})


PR = "pr as (select zona, x ax, y ay, x*0.999e0-y*0.01e0+1.5e0+(ord%5)*0.1e0 bx, y*0.999e0+x*0.01e0-0.7e0+(ord%3)*0.1e0 by_ from v_bay)"


def fit_pairs(spark, sf):
    b = view(spark, sf, "v_bay")
    return b.select("zona", F.col("x").alias("ax"), F.col("y").alias("ay"), F.expr("x*0.999e0-y*0.01e0+1.5e0+(ord%5)*0.1e0").alias("bx"), F.expr("y*0.999e0+x*0.01e0-0.7e0+(ord%3)*0.1e0").alias("by_"))


@query("AGG23_fit_translation", f"""with {PR}, s as (select zona, count(*) n, avg(bx-ax) dx, avg(by_-ay) dy from pr group by 1), q as (select zona, n, dx, dy, sqrt(pow(ax+dx-bx,2)+pow(ay+dy-by_,2)) e, row_number() over (partition by zona order by sqrt(pow(ax+dx-bx,2)+pow(ay+dy-by_,2))) - 1 i from pr join s using (zona))
 select zona, n, round(any_value(dx),4) dx, round(any_value(dy),4) dy, round(max(case when i=round_even((n-1)*0.5e0,0) then e end),4) resid_p50, round(max(case when i=round_even((n-1)*0.9e0,0) then e end),4) resid_p90 from q group by 1,2""")
def agg23(spark, sf):
    return stats.fit_translation(fit_pairs(spark, sf), ["zona"]).withColumns({c: r(F.col(c)) for c in ("dx", "dy", "resid_p50", "resid_p90")})


@query("AGG23_fit_similarity", f"""with {PR}, m as (select zona, count(*) n, covar_pop(ax,bx)+covar_pop(ay,by_) dt, covar_pop(ax,by_)-covar_pop(ay,bx) cr, var_pop(ax)+var_pop(ay) v, avg(ax) mx, avg(ay) my, avg(bx) nx, avg(by_) ny from pr group by 1),
 f as (select *, atan2(cr,dt) th, sqrt(dt*dt+cr*cr)/v sc from m), q as (select zona, n, th, sc, sqrt(pow((ax-mx)*cos(th)*sc-(ay-my)*sin(th)*sc+nx-bx,2)+pow((ax-mx)*sin(th)*sc+(ay-my)*cos(th)*sc+ny-by_,2)) e from pr join f using (zona)),
 k as (select *, row_number() over (partition by zona order by e)-1 i from q) select zona, n, round(any_value(sc),6) scale, round(degrees(any_value(th)),5) rotation_deg, round(max(case when i=round_even((n-1)*0.5e0,0) then e end),4) resid_p50, round(max(case when i=round_even((n-1)*0.9e0,0) then e end),4) resid_p90 from k group by 1,2""")
def agg23b(spark, sf):
    out = stats.fit_similarity(fit_pairs(spark, sf), ["zona"])
    return out.withColumns({"scale": r(F.col("scale"), 6), "rotation_deg": r(F.col("rotation_deg"), 5), "resid_p50": r(F.col("resid_p50")), "resid_p90": r(F.col("resid_p90"))})


@query("AGG24_direction_concentration", f"""with {PR}, v as (select zona, bx-ax dx, by_-ay dy from pr), u as (select zona, dx/sqrt(dx*dx+dy*dy) ux, dy/sqrt(dx*dx+dy*dy) uy from v), c as (select zona, sqrt(pow(avg(ux),2)+pow(avg(uy),2)) r, count(*) n from u group by 1)
 select zona, round(r,5) r, n, case when r>0.8 then 'coherent' when r>=0.5 then 'mixed' else 'scattered' end as "label" from c""")
def agg24(spark, sf):
    v = fit_pairs(spark, sf).select("zona", (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by_") - F.col("ay")).alias("dy"))
    return stats.direction_concentration(v, "dx", "dy", ["zona"]).withColumn("r", r(F.col("r"), 5))


@query("AGG26_majority_attr", "select street, zona from (select street, zona, row_number() over (partition by street order by count(*) desc, zona) rn from v_bay group by 1,2) t where rn=1")
def agg26(spark, sf):
    return stats.majority_attr(view(spark, sf, "v_bay"), ["street"], "zona")


@query("AGG27_offset_grid_search", """with t as (select unnest([-2.0e0,-1.0e0,0.0e0,1.0e0,2.0e0]) v), sh as (select a.v dx, b.v dy from t a, t b), p as (select dx, dy, d.event_id, min(pow(d.x+dx-b.x,2)+pow(d.y+dy-b.y,2)) q from v_detection d join v_bay b on abs(d.x-b.x)<=12 and abs(d.y-b.y)<=12, sh group by 1,2,3),
 k as (select dx, dy, sqrt(q) e, row_number() over (partition by dx,dy order by q)-1 i, count(*) over (partition by dx,dy) n from p) select dx, dy, max(n) n, count(case when e<=3.0e0 then 1 end) hits, round(max(case when i=n//2 then e end),4) median_m from k group by 1,2""")
def agg27(spark, sf):
    out = reports.offset_grid_search(view(spark, sf, "v_detection"), view(spark, sf, "v_bay"), 2.0, 1.0)
    return out.withColumn("median_m", r(F.col("median_m")))


@query("AGG27_raster_shift", """with p as (select distinct cast(floor(x/2.0e0) as bigint) i, cast(floor(y/2.0e0) as bigint) j from v_detection), m as (select distinct cast(floor(x/2.0e0) as bigint) i, cast(floor(y/2.0e0) as bigint) j from v_bay), t as (select cast(unnest([-2,-1,0,1,2]) as bigint) v)
 select a.v di, b.v dj, count(*) overlap from m, t a, t b where exists (select 1 from p where p.i=m.i+a.v and p.j=m.j+b.v) group by 1,2""")
def agg27b(spark, sf):
    return reports.raster_shift_search(view(spark, sf, "v_detection"), view(spark, sf, "v_bay"), 2.0, 4.0)


@query("AGG28_class_breakdown", """with k as (select event_type cls, value, row_number() over (partition by event_type order by value)-1 i, count(*) over (partition by event_type) n from events) select cls, max(n) n, max(value) conf_max, max(case when i=n//2 then value end) conf_p50 from k group by 1 order by n desc, cls limit 12""")
def agg28(spark, sf):
    return reports.class_breakdown(spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("cls"), F.col("value").alias("conf")))


@query("AGG28_frame_overview", """with f as (select distinct frame from v_gt_box), d as (select * from v_det_box where frame%9<>0), n as (select frame, count(*) n from d group by 1), k as (select x1-x0 w, y1-y0 h, row_number() over (order by x1-x0)-1 i, row_number() over (order by y1-y0)-1 j, count(*) over () c from d)
 select (select count(*) from f) frames, (select count(*) from f where frame not in (select frame from n)) empty_frames, cast((select sum(n) from n join f using (frame)) as bigint) detections, max(case when i=c//2 then w end) w_p50, max(case when j=c//2 then h end) h_p50 from k""")
def agg28b(spark, sf):
    return reports.frame_overview(view(spark, sf, "v_gt_box"), view(spark, sf, "v_det_box").filter("frame%9<>0"))


@query("AGG29_profile", """with l as (select 'zona' attribute, zona v from v_bay union all select 'park_txt', park_txt from v_bay union all select 'street', case when ord%3=0 then null else street end from v_bay), c as (select attribute, v, count(*) n from l group by 1,2),
 t as (select attribute, cast(sum(case when v is not null then n end) as bigint) tagged, cast(sum(n) as bigint) total from c group by 1), k as (select *, row_number() over (partition by attribute order by n desc, v) rn from c where v is not null) select attribute, v as "value", n, cast(rn as int) as "rank", tagged, total from k join t using (attribute) where rn<=4""")
def agg29(spark, sf):
    b = view(spark, sf, "v_bay").withColumn("street", F.expr("case when ord%3=0 then null else street end"))
    return stats.profile(b, ["zona", "park_txt", "street"], 4)


@query("AGG34_geometry_diff", """select street, count(*) bays, count(case when ord%4=0 then 1 end) moved, round(max(case when ord%4=0 then 0.5e0 else 0.0e0 end),4) max_moved_m, count(case when ord%5=0 then 1 end) turned from v_bay group by 1""")
def agg34(spark, sf):
    old = ringed(spark, sf)
    new = old.withColumn("ring", geo.rotate_ring(F.col("ring"), "x", "y", F.expr("case when ord%5=0 then 8.0e0 else 2.0e0 end"), F.expr("case when ord%4=0 then 0.5e0 else 0.0e0 end"), F.lit(0.0)))
    return reports.geometry_diff(old, new).withColumn("max_moved_m", r(F.col("max_moved_m")))


@query("AGG35_rect_vs_ring_error", """select zona, count(*) bays, round(max(case when ord%10=0 then 0.2e0 else 0.0e0 end),4) worst_m, count(case when ord%10=0 then 1 end) off from v_bay group by 1""")
def agg35(spark, sf):
    b = ringed(spark, sf)
    b = b.withColumn("ring", geo.rotate_ring(F.col("ring"), "x", "y", F.lit(0.0), F.expr("case when ord%10=0 then 0.2e0 else 0.0e0 end"), F.lit(0.0)))
    return reports.rect_vs_ring_error(b).withColumn("worst_m", r(F.col("worst_m")))


# Buildings stand upright; outlines overlap when none of their four axes parts them.
CAUSES = f"""with {LABELS}, vw as (select bay_id, count(case when occupied then 1 end)*2>count(*) occupied from v_observation group by 1), res as (select bay_id, gt, occupied from lb join vw using (bay_id)),
 bd as (select b.bay_id, min(sqrt(pow(greatest(abs(b.x-h.x-1)-4.5e0,0),2)+pow(greatest(abs(b.y-h.y-1.5e0)-2.5e0,0),2))) bd from v_bay b join v_bay h on h.ord%50<3 and abs(b.x-h.x-1)<=7.5e0 and abs(b.y-h.y-1.5e0)<=5.5e0 group by 1),
 tk as (select r.* from v_ring r join res using (bay_id) where gt),
 hit as (select distinct a.bay_id from v_ring a join tk b on a.bay_id<>b.bay_id and abs(a.x-b.x)<6 and abs(a.y-b.y)<6, lateral (select abs(a.c*b.c+a.s*b.s) p, abs(a.c*b.s-a.s*b.c) q, b.x-a.x dx, b.y-a.y dy) z
  where 2*abs(dx*a.c+dy*a.s) < a.l+b.l*p+b.w*q and 2*abs(dy*a.c-dx*a.s) < a.w+b.l*q+b.w*p and 2*abs(dx*b.c+dy*b.s) < b.l+a.l*p+a.w*q and 2*abs(dy*b.c-dx*b.s) < b.w+a.l*q+a.w*p),
 cs as (select case when bd=0 then 'inside building' when bd<=3 then 'near building' when hit.bay_id is not null then 'overlaps occupied' else 'ordinary' end cause, occupied<>gt wrong from res left join bd using (bay_id) left join hit using (bay_id) where gt is not null)"""


@query("AGG40_error_by_cause", f"{CAUSES} select cause, count(*) bays, count(case when wrong then 1 end) errors, round(count(case when wrong then 1 end)/cast(count(*) as double),4) error_rate from cs group by 1")
def agg40(spark, sf):
    res = labels(spark, sf).join(vote.vote_views(view(spark, sf, "v_observation")).select("bay_id", "occupied"), "bay_id")
    return reports.error_by_cause(res, ringed(spark, sf), buildings(spark, sf))


@query("AGG40_accuracy_outside", f"{CAUSES} select count(*) bays, round(1-count(case when wrong then 1 end)/cast(count(*) as double),4) accuracy from cs where cause<>'inside building'")
def agg40b(spark, sf):
    return reports.accuracy_outside(agg40(spark, sf))


@query("WIN10_observed_spans")
def win10(spark, sf):
    out = evidence.observed_spans(evidence.run_samples(lines(spark, sf)), view(spark, sf, "v_pose"), CAM)
    return out.withColumns({"s0": r(F.col("s0"), 3), "s1": r(F.col("s1"), 3)})


def pixel_boxes(spark, sf):
    """Boxes of 50 px around detections as seen from the frame they are filed under."""
    p = evidence.with_axes(view(spark, sf, "v_pose")).select("frame_idx", F.struct("x", "y", "alt", "yaw", "axes").alias("p"))
    pose = {k: F.col(f"p.{k}") for k in ("x", "y", "alt", "yaw")}
    d = dets(spark, sf).join(p, "frame_idx").withColumn("q", geo.project("x", "y", pose, F.col("p.axes"), CAM))
    return d.select("event_id", "frame_idx", "conf", (F.col("q.x") - 25).alias("x0"), (F.col("q.y") - 15).alias("y0"), (F.col("q.x") + 25).alias("x1"), (F.col("q.y") + 15).alias("y1"))


@query("WIN11_run_extents", f"""with {DET}, b as (select d.event_id, d.frame_idx, d.x, d.y, (50.0e0/{FPX}*30.0e0)*abs(sin(p.yaw))+(30.0e0/{FPX}*30.0e0)*abs(cos(p.yaw)) wx, p.yaw from d join v_pose p using (frame_idx)),
 o as (select b.*, r.run_id, r.length_m, row_number() over (partition by event_id order by sqrt(pow(b.x-least(greatest(b.x,0.0e0),r.length_m),2)+pow(b.y-r.y,2)), r.run_id) rn, sqrt(pow(b.x-least(greatest(b.x,0.0e0),r.length_m),2)+pow(b.y-r.y,2)) dist from b join v_run r on abs(b.y-r.y)<=6.1e0)
 select event_id, frame_idx, run_id, round(least(greatest(x-wx/2,0.0e0),length_m),3) s0, round(least(greatest(x+wx/2,0.0e0),length_m),3) s1 from o where rn=1 and dist<=6.0e0 and least(greatest(x+wx/2,0.0e0),length_m)-least(greatest(x-wx/2,0.0e0),length_m) >= 0.001e0""")
def win11(spark, sf):
    quads = evidence.ground_quads(pixel_boxes(spark, sf), view(spark, sf, "v_pose"), CAM)
    return evidence.run_extents(quads, segs(spark, sf)).select("event_id", "frame_idx", "run_id", r(F.col("s0"), 3).alias("s0"), r(F.col("s1"), 3).alias("s1"))


# Ground outline at 30 m below the camera and roof at 28.5 m, projected corner by corner.
@query("PRJ20_car_boxes", f"""with k as (select p.frame_idx, b.bay_id car_id, b.x, b.y, (ord%10)*0.3e0 ang, p.x px, p.y py, sin(p.yaw) sy, cos(p.yaw) cy from v_pose p join v_bay b on b.x between p.x-60 and p.x+60 and b.y between p.y-60 and p.y+60),
 g as (select *, x+a*2.25e0*cos(ang)-b*0.9e0*sin(ang)-px wx, y+a*2.25e0*sin(ang)+b*0.9e0*cos(ang)-py wy, {FPX}/h f from k, (values (1,1),(1,-1),(-1,-1),(-1,1)) t(a,b), (values (30.0e0),(28.5e0)) z(h)),
 bb as (select frame_idx, car_id, min(200.0e0+f*(wx*sy-wy*cy)) bx0, max(200.0e0+f*(wx*sy-wy*cy)) bx1, min(120.0e0+f*(-wx*cy-wy*sy)) by0, max(120.0e0+f*(-wx*cy-wy*sy)) by1 from g group by 1,2),
 o as (select *, greatest(0.0e0,bx0) x0, greatest(0.0e0,by0) y0, least(400.0e0,bx1) x1, least(240.0e0,by1) y1, (bx1-bx0)*(by1-by0) whole from bb)
 select frame_idx, car_id, round(x0,1) x0, round(y0,1) y0, round(x1,1) x1, round(y1,1) y1 from o where x1-x0>=8 and y1-y0>=8 and whole>0 and (x1-x0)*(y1-y0)/whole>=0.55e0""")
def prj20(spark, sf):
    cars = view(spark, sf, "v_bay").select(F.col("bay_id").alias("car_id"), "x", "y", (F.col("ord") % 10 * F.lit(0.3)).alias("ang"), F.lit(4.5).alias("len"), F.lit(1.8).alias("wid"), F.lit(1.5).alias("height"))
    return evidence.car_boxes(cars, view(spark, sf, "v_pose"), CAM)


@query("WIN11_ground_points", f"with {DET} select event_id, round(d.x,4) x, round(d.y,4) y from d join v_pose p using (frame_idx)")
def ground(spark, sf):
    g = evidence.ground_points(pixel_boxes(spark, sf), view(spark, sf, "v_pose"), CAM)
    return g.select("event_id", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"))
