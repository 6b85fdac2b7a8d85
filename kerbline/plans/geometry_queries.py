"""Scalar functions, predicates and ring geometry."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import geo, numeric, text
from ..functions.geo import Camera
from ..operators import geometry, serve, spatial, stats
from ..session import spread
from .adapters import table, view
from .registry import query

CAM = Camera()
FPX = repr(CAM.f) + "e0"


# The source's own words, as files carry them.
RAW_KIND = "case park_txt when 'perpendicular' then 'Напречно' when 'angled' then 'Косо' else 'Надлъжно' end"


def ringed(spark, sf) -> DataFrame:
    b = spread(view(spark, sf, "v_bay"), "bay_id").withColumn("park_txt", F.expr(RAW_KIND)).withColumn("deg", F.col("ord") % 7 * F.lit(3.0) + 1.0)
    return b.withColumn("ring", geo.bay_rectangle("x", "y", "deg", "park_txt"))


def posed(spark, sf) -> DataFrame:
    return view(spark, sf, "v_pose").withColumn("axes", geo.camera_axes("yaw"))


def pose_cols(df=None) -> dict:
    return {k: F.col(k) for k in ("x", "y", "alt", "yaw")}


def r(c, n=4):
    return F.round(c, n)


@query("PRJ01_to_enu", f"""select bay_id, round((23.33e0 + ord*1e-5 - 23.3298956e0)*{111320.0 * math.cos(math.radians(42.6747105))!r}e0, 4) ex,
 round((42.67e0 + ord*1e-5 - 42.6747105e0)*111320.0e0, 4) ey, round(23.33e0 + ord*1e-5, 7) lon, round(42.67e0 + ord*1e-5, 7) lat from v_bay""")
def prj01(spark, sf):
    b = view(spark, sf, "v_bay").withColumns({"lon": F.lit(23.33) + F.col("ord") * F.lit(1e-5), "lat": F.lit(42.67) + F.col("ord") * F.lit(1e-5)})
    ex, ey = geo.to_enu("lon", "lat")
    b = b.withColumns({"ex": ex, "ey": ey})
    lon, lat = geo.to_lonlat("ex", "ey")
    return b.select("bay_id", r(F.col("ex")).alias("ex"), r(F.col("ey")).alias("ey"), r(lon, 7).alias("lon"), r(lat, 7).alias("lat"))


@query("PRJ02_cut_block", f"""with p as (select bay_id, 23.33e0 + x*1e-5 lon, 42.67e0 + y*1e-5 lat from v_bay) select bay_id from p
 where lon between 23.331e0 - 50e0/(111320.0e0*{math.cos(math.radians(42.671))!r}e0) and 23.331e0 + 50e0/(111320.0e0*{math.cos(math.radians(42.671))!r}e0)
 and lat between 42.671e0 - 50e0/111320.0e0 and 42.671e0 + 50e0/111320.0e0""")
def prj02(spark, sf):
    b = view(spark, sf, "v_bay").withColumns({"lon": F.lit(23.33) + F.col("x") * F.lit(1e-5), "lat": F.lit(42.67) + F.col("y") * F.lit(1e-5)})
    return serve.cut_block(b, "lon", "lat", (23.331, 42.671), 50.0).select("bay_id")


@query("PRJ04_point_in_ring", """select d.event_id, g.bay_id from v_detection d join v_ring g on abs((d.x-g.x)*g.c+(d.y-g.y)*g.s) < g.l/2 and abs((d.y-g.y)*g.c-(d.x-g.x)*g.s) < g.w/2""")
def prj04(spark, sf):
    return spatial.points_in_areas(view(spark, sf, "v_detection").select("event_id", "x", "y"),
                                   ringed(spark, sf).select("bay_id", "ring"), "x", "y", size=12.0).select("event_id", "bay_id")


@query("PRJ04_point_in_geom", """select event_id from v_detection where x > 10.0e0 and x < 160.0e0 and y > -5.0e0 and y < 300.0e0 and not (x > 60.0e0 and x < 90.0e0 and y > 40.0e0 and y < 80.0e0)""")
def prj04b(spark, sf):
    def box(x0, y0, x1, y1):
        return F.array(*[geo.point(F.lit(x), F.lit(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    shape = F.array(F.array(box(10.0, -5.0, 160.0, 300.0), box(60.0, 40.0, 90.0, 80.0)))
    return view(spark, sf, "v_detection").filter(geo.point_in_geom("x", "y", shape)).select("event_id")


@query("PRJ08_ring_metrics", """select bay_id, round(x,4) vx, round(y,4) vy, round(x,4) ax, round(y,4) ay, round(-l*w,4) area, round(sqrt(l*l+w*w)/2,4) radius,
 round(deg + case park_txt when 'perpendicular' then 90.0e0 when 'angled' then 45.0e0 else 0.0e0 end, 4) axis_deg, l long_m, w short_m from v_ring""")
def prj08(spark, sf):
    g = ringed(spark, sf)
    ring = F.col("ring")
    g = g.withColumns({"v": geo.vertex_centroid(ring), "a": geo.area_centroid(ring), "ls": geo.long_short(ring)})
    return g.select("bay_id", r(F.col("v.x")).alias("vx"), r(F.col("v.y")).alias("vy"), r(F.col("a.x")).alias("ax"), r(F.col("a.y")).alias("ay"),
                    r(geo.signed_area(ring)).alias("area"), r(geo.circumradius(ring)).alias("radius"), r(geo.long_axis_deg(ring)).alias("axis_deg"),
                    r(F.col("ls.long_m")).alias("long_m"), r(F.col("ls.short_m")).alias("short_m"))


@query("PRJ09_bay_rectangles", """select bay_id, round(x + (l*c - w*s)/2, 4) x0, round(y + (l*s + w*c)/2, 4) y0, round(x + (l*c + w*s)/2, 4) x1, round(y + (l*s - w*c)/2, 4) y1,
 round(x - (l*c - w*s)/2, 4) x2, round(y - (l*s + w*c)/2, 4) y2 from v_ring""")
def prj09(spark, sf):
    g = ringed(spark, sf)
    pick = [r(F.get("ring", F.lit(i))[k]).alias(f"{k}{i}") for i in range(3) for k in ("x", "y")]
    return g.select("bay_id", *pick)


SEEN = "(select p.frame_idx, d.event_id, d.x-p.x wx, d.y-p.y wy, p.x px, p.y py, p.yaw from v_pose p join v_detection d on p.frame_idx = cast(d.event_id%150 as int)+1)"


def seen(spark, sf):
    p = posed(spark, sf)
    d = view(spark, sf, "v_detection").select("event_id", F.col("x").alias("gx"), F.col("y").alias("gy"), (F.col("event_id") % 150 + 1).cast("int").alias("frame_idx"))
    return p.join(d, "frame_idx")


@query("PRJ10_project", f"""select frame_idx, event_id, round(200.0e0 + {FPX}*(wx*sin(yaw)-wy*cos(yaw))/30.0e0, 4) u,
 round(120.0e0 + {FPX}*(-wx*cos(yaw)-wy*sin(yaw))/30.0e0, 4) v from {SEEN} t""")
def prj10(spark, sf):
    px = geo.project("gx", "gy", pose_cols(), F.col("axes"), CAM)
    return seen(spark, sf).withColumn("p", px).select("frame_idx", "event_id", r(F.col("p.x")).alias("u"), r(F.col("p.y")).alias("v"))


@query("PRJ10_unproject", f"select frame_idx, event_id, round(wx+px, 4) gx, round(wy+py, 4) gy from {SEEN} t")
def prj10b(spark, sf):
    d = seen(spark, sf).withColumn("p", geo.project("gx", "gy", pose_cols(), F.col("axes"), CAM))
    d = d.withColumn("g", geo.unproject("p.x", "p.y", pose_cols(), F.col("axes"), CAM))
    return d.select("frame_idx", "event_id", r(F.col("g.x")).alias("gx"), r(F.col("g.y")).alias("gy"))


@query("PRJ10_tilted_round_trip", f"select frame_idx, event_id, round(wx+px, 3) gx, round(wy+py, 3) gy from {SEEN} t where abs(wx) < 60 and abs(wy) < 60")
def prj10c(spark, sf):
    # a rolled, pitched and spun camera must take every ground point to a pixel and back
    p = view(spark, sf, "v_pose").withColumns({"roll": F.lit(0.05), "pitch": F.lit(0.03), "cam_pitch": F.lit(1.56), "cam_roll": F.lit(-0.2)})
    p = p.withColumn("axes", geo.camera_axes("yaw", "roll", "pitch", "cam_pitch", "cam_roll"))
    d = seen(spark, sf).select("event_id", "gx", "gy", "frame_idx").join(p, "frame_idx")
    d = d.filter((F.abs(F.col("gx") - F.col("x")) < 60) & (F.abs(F.col("gy") - F.col("y")) < 60))
    d = d.withColumn("q", geo.project("gx", "gy", pose_cols(), F.col("axes"), CAM))
    d = d.withColumn("g", geo.unproject("q.x", "q.y", pose_cols(), F.col("axes"), CAM))
    return d.select("frame_idx", "event_id", r(F.col("g.x"), 3).alias("gx"), r(F.col("g.y"), 3).alias("gy"))


@query("PRJ11_camera", f"""select frame_idx, round(alt*400/{FPX},4) width_m, round(alt*240/{FPX},4) height_m, round(alt/{FPX},6) gsd, {CAM.f!r}e0 f, {CAM.fov_v!r}e0 fov_v
 from (select frame_idx, 30.0e0 + frame_idx%20 alt from v_pose) t""")
def prj11(spark, sf):
    p = view(spark, sf, "v_pose").withColumn("alt", F.lit(30.0) + F.col("frame_idx") % 20)
    w, h = CAM.footprint("alt")
    return p.select("frame_idx", r(w).alias("width_m"), r(h).alias("height_m"), r(CAM.gsd("alt"), 6).alias("gsd"), F.lit(CAM.f).alias("f"), F.lit(CAM.fov_v).alias("fov_v"))


@query("PRJ12_footprint", f"""select event_id, round(30.0e0*(sqrt(pow(tan(0.3927e0),2)+pow(tan(0.3927e0)*0.6e0,2))+tan(0.06e0)), 4) reach,
 abs(wx*cos(yaw)+wy*sin(yaw)) <= 30.0e0*240/{FPX}/2*1.1e0 and abs(wy*cos(yaw)-wx*sin(yaw)) <= 30.0e0*400/{FPX}/2*1.1e0 inside from {SEEN} t""")
def prj12(spark, sf):
    return seen(spark, sf).select("event_id", r(CAM.reach("alt")).alias("reach"), geo.in_footprint("gx", "gy", pose_cols(), CAM, 1.1).alias("inside"))


@query("PRJ13_in_shot", f"""with k as (select p.frame_idx, g.bay_id, {FPX}/30.0e0 f, g.x-p.x wx, g.y-p.y wy, g.l, g.w, g.c, g.s, sin(p.yaw) sy, cos(p.yaw) cy from v_pose p join v_ring g
  on g.x between p.x-40 and p.x+40 and g.y between p.y-40 and p.y+40),
 q as (select frame_idx, bay_id, 200.0e0+f*((wx+a*l/2*c-b*w/2*s)*sy-(wy+a*l/2*s+b*w/2*c)*cy) u, 120.0e0+f*(-(wx+a*l/2*c-b*w/2*s)*cy-(wy+a*l/2*s+b*w/2*c)*sy) v
  from k, (values (1,1),(1,-1),(-1,-1),(-1,1)) t(a,b))
 select frame_idx, bay_id, bool_and(u>=0 and u<400 and v>=0 and v<240) fully from q group by 1,2 having max(u)>=0 and min(u)<400 and max(v)>=0 and min(v)<240""")
def prj13(spark, sf):
    from ..operators.evidence import frame_bay_views
    v = frame_bay_views(view(spark, sf, "v_pose"), ringed(spark, sf), CAM, mode="partial")
    return v.select("frame_idx", "bay_id", "fully")


CORE = "(select event_id, value/4 core_chroma, (event_id%10)/200.0e0 core_dark_frac, (event_id%7)/30.0e0 core_paint_frac, 75.0e0+event_id%37 core_brightness, 30.0e0+event_id%25 core_std, 100.0e0+event_id%40 f_mode from events)"


def cores(spark, sf):
    return spark.sql(CORE.strip("()").replace("from events", f"from parquet.`{sf}/events.parquet`"))


@query("PRJ14_classify_core", f"""select event_id, core_chroma>12.7e0 or core_dark_frac>0.02e0 or core_paint_frac>0.15e0 or not (core_brightness>82 and core_brightness<102) or core_std>50 occupied from {CORE} t""")
def prj14(spark, sf):
    return cores(spark, sf).select("event_id", text.classify_core().alias("occupied"))


@query("PRJ15_classify_variants", f"""with c as (select *, f_mode/121.0e0 k from {CORE} t), v as (select event_id,
 core_chroma>12.7e0 a, core_dark_frac>0.02e0 b, core_paint_frac>0.15e0 p, not (core_brightness>82 and core_brightness<102) d, core_std>50 e,
 core_chroma>12.7e0*k or core_dark_frac>0.02e0 or core_paint_frac>0.15e0 or not (core_brightness>82.0e0*k and core_brightness<102.0e0*k) or core_std>50.0e0*k r from c)
 select 'current' variant, count(case when a or b or p or d or e then 1 end) occupied from v union all select 'drop bright', count(case when a or b or p or e then 1 end) from v
 union all select 'drop chroma', count(case when b or p or d or e then 1 end) from v union all select 'drop dark', count(case when a or p or d or e then 1 end) from v
 union all select 'drop paint', count(case when a or b or d or e then 1 end) from v union all select 'drop std', count(case when a or b or p or d then 1 end) from v
 union all select 'rel f_mode', count(case when r then 1 end) from v""")
def prj15(spark, sf):
    variants = {"current": text.classify_core(), **{f"drop {t}": text.classify_core(drop=(t,)) for t in text.CORE_TESTS},
                "rel f_mode": text.classify_core(scale_by="f_mode")}
    long = geometry.variants(cores(spark, sf), variants, ["event_id"])
    return long.groupBy("variant").agg(numeric.count_if(F.col("occupied")).alias("occupied"))


STREETS = """(select c_custkey id, case c_custkey%5 when 0 then 'бул. ' when 1 then 'ул. ' when 2 then 'УЛ.' when 3 then '  пл. ' else '' end || case c_custkey%4 when 0 then 'Св.  ' when 1 then 'ген. ' when 2 then 'д-р ' else '' end || c_mktsegment a,
 case c_custkey%3 when 0 then lower(c_mktsegment) when 1 then 'улица ' || c_mktsegment else 'x' end b from customer)"""


@query("PRJ16_norm_street", f"""with n as (select id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(trim(lower(a)), '^(ул\\.|бул\\.|жк|кв\\.|пл\\.)\\s*', ''),
 'арх.','архитект'),'св.','свети'),'проф.','професор'),'ген.','генерал'),'инж.','инженер'),'д-р','доктор'), '\\s+', ' ', 'g')) a,
 trim(regexp_replace(trim(lower(b)), '^(ул\\.|бул\\.|жк|кв\\.|пл\\.)\\s*', '')) b from {STREETS} t)
 select id, a norm, contains(a,b) or contains(b,a) matches from n""")
def prj16(spark, sf):
    s = spark.sql("select * from " + STREETS.replace("from customer", f"from parquet.`{sf}/customer.parquet`"))
    return s.select("id", text.norm_street("a").alias("norm"), text.street_match("a", "b").alias("matches"))


TAGS = """(select p_partkey id, case p_partkey%9 when 0 then '12,5' when 1 then '12 m' when 2 then concat(cast(p_size as {t}),'''') when 3 then '5;6' when 4 then cast(p_size as {t}) when 5 then 'tall' when 6 then '' when 7 then '30 ft' end h,
 case p_partkey%4 when 0 then cast(p_size as {t}) when 1 then '2.6' when 2 then '0' end lv, case p_partkey%5 when 0 then '2' when 1 then '1' when 2 then 'x' when 3 then '4' end lanes,
 case p_partkey%3 when 0 then 'primary' when 1 then 'residential' end hw from part)"""
TAGS_N = """case i when 0 then 12.5e0 when 1 then 12.0e0 when 2 then p*0.3048e0 when 3 then 5.0e0 when 4 then p*1.0e0 when 7 then 30.0e0*0.3048e0 end"""


@query("PRJ17_parse_height", f"""with t as (select p_partkey id, p_partkey%9 i, p_size p, case p_partkey%4 when 0 then p_size*1.0e0 when 1 then 2.6e0 when 2 then 0.0e0 end lv, p_partkey%5 la, p_partkey%3 hw from part),
 v as (select *, {TAGS_N} h from t), w as (select *, round_even(h/3.0e0, 0) fh from v)
 select id, cast(case when lv>=1 then least(40, round_even(lv,0)) when h>0 then greatest(1, least(40, fh)) else 4 end as int) floors,
 round(case when lv>=1 then 3.0e0 when h>0 then h/greatest(1, least(40, fh)) else 3.0e0 end, 4) floor_m,
 case la when 0 then 6.5e0 when 1 then 5.0e0 when 3 then 13.0e0 else case when hw=0 then 9.0e0 else 6.5e0 end end width_m from w""")
def prj17(spark, sf):
    t = spark.sql("select * from " + TAGS.replace("{t}", "string").replace("from part", f"from parquet.`{sf}/part.parquet`"))
    t = t.withColumn("p", text.parse_height("lv", "h"))
    return t.select("id", F.col("p.floors").alias("floors"), r(F.col("p.floor_m")).alias("floor_m"), text.road_width("lanes", "hw").alias("width_m"))


@query("PRJ18_apply_corrections", """select bay_id, case when ord%5=0 then round(x + 1.5e0, 4) when ord%5=1 then round(x + 0.25e0, 4) else round(x, 4) end cx,
 case when ord%5=0 then round(y - 0.5e0, 4) when ord%5=1 then round(y + 0.5e0, 4) else round(y, 4) end cy, round(case when ord%5=1 then -6.0e0 else -l*w end, 4) area from v_ring""")
def prj18(spark, sf):
    g = ringed(spark, sf)
    moves = g.filter("ord%5=0").select("bay_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.lit(8.0).alias("rot_deg"), F.lit(1.5).alias("dx"),
                                       F.lit(-0.5).alias("dy"), F.lit(None).cast(g.schema["ring"].dataType).alias("ring"))
    drawn = g.filter("ord%5=1").select("bay_id", *[F.lit(None).cast("double").alias(c) for c in ("cx", "cy", "rot_deg", "dx", "dy")],
                                       geo.rectangle(F.col("x") + 0.25, F.col("y") + 0.5, F.lit(1.0), F.lit(0.0), F.lit(3.0), F.lit(2.0)).alias("ring"))
    out = geometry.apply_corrections(g.select("bay_id", "ring"), moves.unionByName(drawn))
    return out.select("bay_id", r(F.col("cx")).alias("cx"), r(F.col("cy")).alias("cy"), r(geo.signed_area(F.col("ring"))).alias("area"))


@query("PRJ19_is_oblique", "select event_id, value*5>180 and (event_id%30)-10.0e0 > 10 oblique from events")
def prj19(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", text.is_oblique(F.col("value") * 5, F.col("event_id") % 30 - F.lit(10.0)).alias("oblique"))


LINES = """(select l_orderkey*10+l_linenumber id, case l_orderkey%11 when 0 then '0 0.5 0.5 0.1' when 1 then '0 a 0.5 0.1 0.1' when 2 then '1 0.5 0.5 0.1 0.1' when 3 then '0 1.5 0.5 0.1 0.1'
 when 4 then '0 0.5 0.5 0 0.1' when 5 then '0 0.5 0.5 0.6 0.1' when 6 then '0 0.02 0.5 0.1 0.1' when 7 then '2 -0.1 0.5 0.9 0.1' else '0 0.5  0.25 0.1 0.08' end line from lineitem)"""


@query("PRJ21_validate_labels", f"""with p(k, problem) as (values (0,'field count'),(1,'not numeric'),(2,'class'),(3,'cx range'),(3,'outside image'),(4,'zero area'),(5,'size'),(6,'outside image'),
 (7,'class'),(7,'cx range'),(7,'size'),(7,'outside image')) select l_orderkey*10+l_linenumber id, problem from lineitem join p on l_orderkey%11=k""")
def prj21(spark, sf):
    rows = spark.sql("select * from " + LINES.replace("from lineitem", f"from parquet.`{sf}/lineitem.parquet`"))
    return geometry.validate_labels(rows, "line").select("id", "problem")


@query("PRJ24_densify", """with r as (select run_id, y, unnest(generate_series(0, cast(floor(length_m/5) as bigint))) k from v_run) select run_id, k, round(k*5.0e0,4) s, round(k*5.0e0,4) x, round(y,4) y from r""")
def prj24(spark, sf):
    d = geometry.densify(run_lines(spark, sf), "run_id", "line", 5.0)
    return d.select("run_id", "k", r(F.col("s")).alias("s"), r(F.col("x")).alias("x"), r(F.col("y")).alias("y"))


def run_lines(spark, sf) -> DataFrame:
    """Kerb lines with a bend: three vertices per run."""
    runs = view(spark, sf, "v_run")
    pts = F.array(geo.point(F.lit(0.0), "y"), geo.point(F.lit(100.3), "y"), geo.point("length_m", "y"))
    return runs.withColumn("line", pts)


@query("PRJ24_point_at", """select event_id, run_id, round(least(greatest(s0+(s1-s0)/2, 0), 230.1e0), 4) x, round(y,4) y from v_span join v_run using (run_id)""")
def prj24b(spark, sf):
    spans = view(spark, sf, "v_span").select("event_id", "run_id", (F.col("s0") + (F.col("s1") - F.col("s0")) / 2).alias("s"))
    joined = spans.join(run_lines(spark, sf).select("run_id", "line"), "run_id").withColumn("p", geometry.point_at(F.col("line"), F.col("s")))
    return joined.select("event_id", "run_id", r(F.col("p.x")).alias("x"), r(F.col("p.y")).alias("y"))


@query("PRJ24_slice", """select event_id, round(least(s1,230.1e0)-s0,4) len, cast(case when s0<100.3e0 and least(s1,230.1e0)>100.3e0 then 3 else 2 end as int) n, round(s0,4) x0 from v_span join v_run using (run_id) where s0 < 230""")
def prj24c(spark, sf):
    spans = view(spark, sf, "v_span").filter("s0 < 230").select("event_id", "run_id", "s0", "s1")
    j = spans.join(run_lines(spark, sf).select("run_id", "line"), "run_id").withColumn("part", geometry.slice_by_arclength(F.col("line"), F.col("s0"), F.col("s1")))
    return j.select("event_id", r(geometry.polyline_length(F.col("part"))).alias("len"), F.size("part").alias("n"), r(F.get("part", F.lit(0)).x).alias("x0"))


@query("PRJ25_validate_bbox", """select c_custkey id, c_custkey%4 in (0,3) box_ok, c_custkey%5 in (0,4) point_ok from customer""")
def prj25(spark, sf):
    c = spark.sql(f"""select c_custkey id, case c_custkey%4 when 0 then '1,2,3.5,4' when 1 then '1,2,3' when 2 then '1,x,3,4' else ' 1 ,2,-3e2,4' end b,
      case c_custkey%5 when 0 then '23.3,42.6' when 1 then '190,42' when 2 then 'NaN,42' when 3 then '23.3' else '-180,90' end p from parquet.`{sf}/customer.parquet`""")
    return c.select("id", text.valid_bbox("b").isNotNull().alias("box_ok"), text.valid_lonlat("p").isNotNull().alias("point_ok"))


@query("PRJ22_clip_lines", """with t as (select *, cast(substr(run_id,5) as bigint) n from v_run where y between -150.0e0 and 150.0e0) select run_id, cast(0 as bigint) part, cast(2 as bigint) vertices, round(150.0e0,3) len from t""")
def prj22(spark, sf):
    out = geometry.clip_lines(run_lines(spark, sf), "run_id", "line", 150.0)
    return out.groupBy("run_id", "part").agg((F.count(F.lit(1)) + 1 - F.count(F.when(F.col("ax") == F.col("bx"), 1)) - F.count(F.when(F.col("seg") > 0, 1))).alias("vertices"),
                                             r(F.sum(geo.distance("ax", "ay", "bx", "by")), 3).alias("len"))


@query("PRJ23_clip_polygons", """with t as (select bay_id, greatest(x-2.0e0,-100.0e0) a, least(x+2.0e0,100.0e0) b, greatest(y-1.0e0,-100.0e0) c, least(y+1.0e0,100.0e0) d from v_bay) select bay_id, round((b-a)*(d-c),4) area from t where b>a and d>c""")
def prj23(spark, sf):
    b = spread(view(spark, sf, "v_bay"), "bay_id").withColumn("ring", geo.rectangle("x", "y", F.lit(1.0), F.lit(0.0), F.lit(4.0), F.lit(2.0)))
    out = geometry.clip_polygons(b.select("bay_id", "ring"), "ring", 100.0)
    return out.select("bay_id", r(F.abs(geo.signed_area(F.col("ring")))).alias("area"))


@query("PRJ23_simplify_rings", "select bay_id, cast(4 as int) vertices, round(l*w,4) area from v_ring")
def prj23b(spark, sf):
    # an edge midpoint added to every side must go again
    mids = F.flatten(F.transform(geo.edges(F.col("ring")), lambda e: F.array(e.a, geo.point((e.a.x + e.b.x) / 2, (e.a.y + e.b.y) / 2))))
    out = geometry.simplify_rings(ringed(spark, sf).select("bay_id", mids.alias("ring")), "ring", 0.05)
    return out.select("bay_id", F.size("ring").alias("vertices"), r(F.abs(geo.signed_area(F.col("ring")))).alias("area"))


# ---- scalars --------------------------------------------------------------------

@query("SCA01_haversine", """select bay_id, round(2*6371000.0e0*asin(least(1.0e0, sqrt(pow(sin(radians(y*1e-5)/2),2) + cos(radians(42.67e0))*cos(radians(42.67e0+y*1e-5))*pow(sin(radians(x*1e-5)/2),2)))), 3) d from v_bay""")
def sca01(spark, sf):
    b = view(spark, sf, "v_bay")
    return b.select("bay_id", r(geo.haversine(F.lit(23.33), F.lit(42.67), F.lit(23.33) + F.col("x") * 1e-5, F.lit(42.67) + F.col("y") * 1e-5), 3).alias("d"))


@query("SCA02_formats", """select event_id, case when value*20<950 then concat(cast(cast(floor(value*2+0.5)*10 as bigint) as varchar),' m') else concat(printf('%.1f', floor(value*20/100+0.5)/10),' km') end dist,
 case when floor(value*100/60+0.5)<1 then '< 1 min' when floor(value*100/60+0.5)<60 then concat('~',cast(cast(floor(value*100/60+0.5) as bigint) as varchar),' min')
 else concat('~',cast(cast(floor(floor(value*100/60+0.5)/60) as bigint) as varchar),' h ',cast(cast(floor(value*100/60+0.5) as bigint)%60 as varchar),' min') end dur,
 case when event_id%9=0 then '—' else concat(printf('%.1f', (event_id%8)/8.0e0*100),'%') end pct,
 case when value*100<60 then concat(cast(cast(floor(value*100+0.5) as bigint) as varchar),'s') when value*100<3600 then concat(cast(cast(floor(value*100/60) as bigint) as varchar),'m ',lpad(cast(cast(floor((value*100)%60+0.5) as bigint) as varchar),2,'0'),'s')
 else concat(cast(cast(floor(value*100/3600) as bigint) as varchar),'h ',lpad(cast(cast(floor(((value*100)%3600)/60) as bigint) as varchar),2,'0'),'m') end aged from events""")
def sca02(spark, sf):
    e = table(spark, sf, "events").withColumn("f", F.expr("case when event_id%9<>0 then (event_id%8)/8.0e0 end"))
    return e.select("event_id", text.format_distance(F.col("value") * 20).alias("dist"), text.format_duration(F.col("value") * 100).alias("dur"),
                    text.percent("f").alias("pct"), text.age(F.col("value") * 100).alias("aged"))


@query("SCA03_health_tones", """select event_id, case when value>=300 then 'critical' when value>=60 then 'warn' when event_id%70>=50 then 'warn' when event_id%70>0 then 'good' else 'idle' end queue,
 case when event_id%8>=5 then 'warn' when event_id%8>0 then 'good' else 'idle' end lease, case when event_id%5=0 then 'idle' when value/500>=0.1e0 then 'critical' when value>0 then 'warn' else 'good' end failure,
 case when event_id%5=0 then 'idle' when value/50<0.9e0 then 'critical' when value/50<0.95e0 then 'warn' else 'good' end accuracy, case when event_id%5=0 then 'idle' when value>=120 then 'warn' else 'good' end mission from events""")
def sca03(spark, sf):
    e = table(spark, sf, "events").withColumns({"rate": F.expr("case when event_id%5<>0 then value/500 end"), "acc": F.expr("case when event_id%5<>0 then value/50 end"),
                                                "idle": F.expr("case when event_id%5<>0 then value end"), "d": F.expr("event_id%70"), "x": F.expr("event_id%8")})
    return e.select("event_id", text.queue_tone("d", "value").alias("queue"), text.lease_tone("x").alias("lease"), text.failure_tone("rate").alias("failure"),
                    text.accuracy_tone("acc").alias("accuracy"), text.mission_tone("idle").alias("mission"))


@query("SCA04_angles", """with a as (select event_id, value/10-20 a from events), w as (select *, a+pi() s from a) select event_id, round(s-2*pi()*floor(s/(2*pi()))-pi(),6) wrapped,
 round(least(abs(a*30)%180, 180-abs(a*30)%180),6) diff from w""")
def sca04(spark, sf):
    e = table(spark, sf, "events").withColumn("a", F.col("value") / 10 - 20)
    return e.select("event_id", r(numeric.wrap_angle("a"), 6).alias("wrapped"), r(numeric.axis_diff(F.col("a") * 30, F.lit(0.0)), 6).alias("diff"))


@query("SCA05_mercator_px", """with p as (select bay_id, 23.33e0+x*1e-3 lon, sin(radians(42.67e0+y*1e-4)) s from v_bay) select bay_id, round((lon+180)/360*256*pow(2,18),2) u, round((0.5e0-ln((1+s)/(1-s))/(4*pi()))*256*pow(2,18),2) v from p""")
def sca05(spark, sf):
    u, v = geo.mercator_px(F.lit(23.33) + F.col("x") * 1e-3, F.lit(42.67) + F.col("y") * 1e-4, 18)
    return view(spark, sf, "v_bay").select("bay_id", r(u, 2).alias("u"), r(v, 2).alias("v"))


@query("SCA06_frame_no", """select event_id, cast(case event_id%4 when 0 then event_id%1000 when 1 then event_id%1000 when 2 then -1 else event_id end as int) n from events""")
def sca06(spark, sf):
    e = spark.sql(f"""select event_id, case event_id%4 when 0 then concat('a/b/f34_frame_', lpad(cast(event_id%1000 as string),4,'0'), '.jpg') when 1 then concat('frame_', cast(event_id%1000 as string), '.png')
      when 2 then 'frame_last.png' else cast(event_id as string) end f from parquet.`{sf}/events.parquet`""")
    return e.select("event_id", text.frame_no("f").alias("n"))


@query("SCA07_iou", """with p as (select box_id, greatest(0, least(g.x1,d.x1)-greatest(g.x0,d.x0))*greatest(0, least(g.y1,d.y1)-greatest(g.y0,d.y0)) i,
 (g.x1-g.x0)*(g.y1-g.y0)+(d.x1-d.x0)*(d.y1-d.y0) t from (select box_id, min(x0) x0, min(x1) x1, min(y0) y0, min(y1) y1 from v_gt_box group by 1) g
 join (select box_id, min(x0) x0, min(x1) x1, min(y0) y0, min(y1) y1 from v_det_box group by 1) d using (box_id)) select box_id, round(i/(t-i),6) iou from p""")
def sca07(spark, sf):
    def one(name):
        return view(spark, sf, name).groupBy("box_id").agg(*[F.min(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    g, d = one("v_gt_box").alias("g"), one("v_det_box").alias("d")
    cols = ("x0", "y0", "x1", "y1")
    return g.join(d, "box_id").select("box_id", r(geo.iou({c: F.col(f"g.{c}") for c in cols}, {c: F.col(f"d.{c}") for c in cols}), 6).alias("iou"))


@query("SCA08_key_hash", "select c_custkey id, sha256(c_name) h from customer")
def sca08(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), text.key_hash("c_name").alias("h"))


@query("SCA09_json", """select bay_id, concat('{"bay_id":"',bay_id,'","zona":"',zona,'"}') doc, zona from v_bay""")
def sca09(spark, sf):
    doc = F.to_json(F.struct("bay_id", "zona"))
    return view(spark, sf, "v_bay").select("bay_id", doc.alias("doc")).withColumn("zona", F.get_json_object("doc", "$.zona"))


@query("SCA10_rebase_time", """select event_id, timestamp '2025-05-01 08:00:00' + (observed_at - min(observed_at) over (partition by drone_id)) at_ from v_observation""")
def sca10(spark, sf):
    o = view(spark, sf, "v_observation")
    first = o.groupBy("drone_id").agg(F.min("observed_at").alias("first"))
    return o.join(first, "drone_id").select("event_id", text.rebase_time("observed_at", "first", F.lit("2025-05-01 08:00:00").cast("timestamp_ntz")).alias("at_"))


@query("SCA11_percentiles", """with r as (select event_type, value v, row_number() over (partition by event_type order by value) - 1 i, count(*) over (partition by event_type) n from events)
 select event_type, max(case when i=round_even((n-1)*0.9e0,0) then v end) nearest, max(case when i=least(floor(n*0.9e0),n-1) then v end) truncated, max(case when i=n//2 then v end) upper_median,
 round(quantile_cont(v, 0.9),6) continuous from r group by 1""")
def sca11(spark, sf):
    p = stats.percentiles(table(spark, sf, "events"), ["event_type"], "value",
                          {"nearest": (0.9, "nearest"), "truncated": (0.9, "truncate"), "upper_median": (0.5, "upper_median"), "continuous": (0.9, "continuous")})
    return p.withColumn("continuous", r(F.col("continuous"), 6))


@query("SCA12_kerb_colour", """select event_id, case when event_id%6=0 or event_id%10=0 then '#C6CED2' when event_id%4=0 then '#D7263D' when (event_id%4)/cast(event_id%10 as double) < 0.25 then '#F5A524' else '#2E9E5B' end colour from events""")
def sca12(spark, sf):
    e = table(spark, sf, "events").withColumns({"free": F.expr("case when event_id%6<>0 then event_id%4 end"), "cars": F.lit(1), "cap": F.expr("event_id%10")})
    return e.select("event_id", text.kerb_colour("free", "cars", "cap").alias("colour"))
