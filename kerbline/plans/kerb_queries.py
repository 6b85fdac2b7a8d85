"""Kerb geometry, clustering and interval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geo
from ..operators import components, geometry, intervals, runs, spatial
from .adapters import AS_OF, WINDOW_S, view
from .registry import query
from .state_queries import CUT


def r(c, n=4):
    return F.round(c, n)


def lines(spark, sf) -> DataFrame:
    """Straight kerbs as lines with one vertex in the middle."""
    v = view(spark, sf, "v_run")
    return v.withColumn("line", F.array(geo.point(F.lit(0.0), "y"), geo.point(F.lit(100.3), "y"), geo.point("length_m", "y")))


def segs(spark, sf) -> DataFrame:
    return spatial.polyline_segments(lines(spark, sf), "run_id", "line")


def bays_u(spark, sf) -> DataFrame:
    return view(spark, sf, "v_bay").withColumns({"ux": F.lit(1.0), "uy": F.lit(0.0)})


def mission(df) -> DataFrame:
    return df.withColumn("mission_id", F.concat(F.lit("m"), F.floor((F.dayofmonth("observed_at") - 1) / 5).cast("string")))


# ---- SQL building blocks -------------------------------------------------------

def merged(src: str, by: str, below: str, name: str) -> str:
    """CTE chain that unions intervals of ``src`` (columns ``by, s0, s1``)."""
    return f"""{name}_a as (select distinct {by}, least(s0,s1) s0, greatest(s0,s1) s1 from {src}),
 {name}_b as (select *, max(s1) over (partition by {by} order by s0, s1 rows between unbounded preceding and 1 preceding) reach from {name}_a),
 {name}_c as (select *, sum(case when reach is null or s0-reach >= {below} then 1 else 0 end) over (partition by {by} order by s0, s1) isle from {name}_b),
 {name} as (select {by}, min(s0) s0, max(s1) s1 from {name}_c group by {by}, isle)"""


def gaps_sql(occ: str, obs: str, name: str) -> str:
    """CTE chain for free stretches of ``obs`` outside ``occ`` with the places that fit."""
    return f"""{name}_a as (select o.run_id, o.s0 o0, greatest(c.s0,o.s0) a, least(c.s1,o.s1) b from {obs} o join {occ} c on c.run_id=o.run_id and c.s1>o.s0 and c.s0<o.s1
 union select run_id, s0, s0, s0 from {obs} union select run_id, s0, s1, s1 from {obs}),
 {name}_b as (select *, max(b) over (partition by run_id, o0 order by a, b rows between unbounded preceding and 1 preceding) reach from {name}_a),
 {name}_c as (select g.run_id, reach s0, a s1, length_m, pitch_m, capacity from {name}_b g join v_run r on r.run_id=g.run_id where a>reach),
 {name} as (select *, cast(floor((s1-s0-case when s0>1e-6 and s1<length_m-1e-6 then 0.5e0 else 0.0e0 end)/pitch_m) as bigint) spaces from {name}_c)"""


SPAN_OK = "(select s.* from v_span s join v_run r on r.run_id=s.run_id)"
NEAR_RUN = "(select d.event_id, d.frame_idx, d.observed_at, d.x, d.y, r.run_id, least(greatest(d.x,0.0e0),r.length_m) s, d.y-r.y lat_m, sqrt(pow(d.x-least(greatest(d.x,0.0e0),r.length_m),2)+pow(d.y-r.y,2)) dist from v_detection d join v_run r on abs(d.y-r.y) <= 6.5e0)"


@query("JON10_locate", f'select event_id, run_id, round(s,4) s, round(lat_m,4) as "lateral", round(dist,4) dist from {NEAR_RUN} t where dist <= 6.0e0')
def jon10(spark, sf):
    out = spatial.locate(view(spark, sf, "v_detection"), segs(spark, sf), "event_id", "x", "y", "run_id", 6.0)
    return out.select("event_id", "run_id", r(F.col("s")).alias("s"), r(F.col("lateral")).alias("lateral"), r(F.col("dist")).alias("dist"))


OWN_RUN = f"(select * from (select *, row_number() over (partition by event_id order by dist, run_id) rn from {NEAR_RUN} t where dist <= 6.0e0) z where rn=1)"


@query("JON11_assign_runs", f"select event_id, run_id, round(s,4) s, round(dist,4) dist from {OWN_RUN} t")
def jon11(spark, sf):
    out = spatial.assign_runs(view(spark, sf, "v_detection"), segs(spark, sf), "event_id", "x", "y")
    return out.select("event_id", "run_id", r(F.col("s")).alias("s"), r(F.col("dist")).alias("dist"))


@query("AGG25_lateral_fit", f"""with n as (select run_id, lat_m from {NEAR_RUN} t where dist <= 6.0e0), k as (select *, row_number() over (partition by run_id order by lat_m) - 1 i, count(*) over (partition by run_id) c from n),
 m as (select run_id, max(case when i = c//2 then lat_m end) med, max(c) c from k group by 1), d as (select n.run_id, abs(lat_m-med) dev from n join m using (run_id)),
 e as (select *, row_number() over (partition by run_id order by dev) - 1 i, count(*) over (partition by run_id) c from d), f as (select run_id, max(case when i = c//2 then dev end) mad from e group by 1)
 select r.run_id, round(case when coalesce(c,0)>=5 then med else 0.0e0 end,4) delta, coalesce(c,0) n, round(case when coalesce(c,0)>=5 then mad end,4) mad from v_run r left join m using (run_id) left join f using (run_id)""")
def agg25(spark, sf):
    out = runs.lateral_fit(view(spark, sf, "v_detection"), segs(spark, sf), view(spark, sf, "v_run"))
    return out.select("run_id", r(F.col("delta")).alias("delta"), "n", r(F.col("mad")).alias("mad"))


@query("JON21_segment_overlap", """with seg as (select run_id, unnest(range(cast(ceil(length_m/18) as int))) seg, length_m, ceil(length_m/18) n from v_run),
 s as (select run_id, cast(seg as int) seg, seg*(length_m/n) a, (seg+1)*(length_m/n) b from seg)
 select s.run_id, s.seg, round(coalesce(sum(case when v.run_id is not null then greatest(0.0e0, least(b,s1)-greatest(a,s0)) end),0.0e0),4) overlap_m from s left join v_span v on v.run_id=s.run_id and v.s0<=b and v.s1>=a group by all""")
def jon21(spark, sf):
    out = intervals.segment_overlap(view(spark, sf, "v_span").select("run_id", "s0", "s1"), intervals.segments(view(spark, sf, "v_run")))
    return out.select("run_id", "seg", r(F.col("overlap_m")).alias("overlap_m"))


@query("JON21_segment_counts", f"""with seg as (select run_id, unnest(range(cast(ceil(length_m/18) as int))) seg, length_m, ceil(length_m/18) n from v_run),
 s as (select run_id, cast(seg as int) seg, seg*(length_m/n) a, (seg+1)*(length_m/n) b from seg), o as (select * from {OWN_RUN} t)
 select s.run_id, s.seg, count(o.event_id) cars from s left join o on o.run_id=s.run_id and o.s>=a and o.s<b group by all""")
def jon21b(spark, sf):
    pts = spatial.assign_runs(view(spark, sf, "v_detection"), segs(spark, sf), "event_id", "x", "y").select("run_id", "s")
    return intervals.segment_counts(pts, intervals.segments(view(spark, sf, "v_run"))).select("run_id", "seg", "cars")


@query("WIN01_arclength", """select flight, idx, round(sum(coalesce(st,0.0e0)) over (partition by flight order by idx),3) s from
 (select *, sqrt(pow(x-lag(x) over w,2)+pow(y-lag(y) over w,2)) st from v_track window w as (partition by flight order by idx)) t""")
def win01(spark, sf):
    return runs.arclength(view(spark, sf, "v_track").select("flight", "idx", "x", "y"), ["flight"], "idx", chunk=1000).select("flight", "idx", r(F.col("s"), 3).alias("s"))


def spans(spark, sf):
    return view(spark, sf, "v_span").join(view(spark, sf, "v_run").select("run_id"), "run_id", "left_semi")


@query("WIN02_merge_intervals", f"with {merged('v_span', 'run_id', '0.0e0', 'm')} select run_id, round(s0,4) s0, round(s1,4) s1 from m")
def win02(spark, sf):
    return intervals.merge_intervals(view(spark, sf, "v_span"), ["run_id"], join_below=0.0).select("run_id", r(F.col("s0")).alias("s0"), r(F.col("s1")).alias("s1"))


@query("WIN02_merge_join_cars", f"with {merged('v_span', 'run_id', '1.5e0', 'm')} select run_id, round(s0,4) s0, round(s1,4) s1 from m")
def win02b(spark, sf):
    return intervals.merge_intervals(view(spark, sf, "v_span"), ["run_id"]).select("run_id", r(F.col("s0")).alias("s0"), r(F.col("s1")).alias("s1"))


@query("WIN03_runs_of_true", """with c as (select distinct run_id, cast(floor(s0/0.5) as bigint) k from v_span join v_run using (run_id)), g as (select *, k-row_number() over (partition by run_id order by k) g from c)
 select run_id, min(k)*0.5e0 s0, least((max(k)+1)*0.5e0, 230.1e0) s1 from g group by run_id, g""")
def win03(spark, sf):
    c = spans(spark, sf).select("run_id", F.floor(F.col("s0") / 0.5).alias("k")).withColumn("len", F.lit(230.1))
    return intervals.runs_of_true(c, ["run_id"], length="len")


CELLS = f"""cars as (select run_id, frame_idx, s-2.2e0 s0, s+2.2e0 s1 from {OWN_RUN} t), sp as (select run_id, frame_idx, s0, s1 from {SPAN_OK} t),
 ob as (select distinct run_id, frame_idx, k from (select run_id, frame_idx, unnest(generate_series(cast(greatest(0,floor(s0/0.5e0)) as bigint), cast(least(461, ceil(s1/0.5e0))-1 as bigint))) k from sp) t),
 oc as (select distinct run_id, frame_idx, k from (select run_id, frame_idx, unnest(generate_series(cast(greatest(0,floor(s0/0.5e0)) as bigint), cast(least(461, ceil(s1/0.5e0))-1 as bigint))) k from cars) t),
 votes as (select ob.run_id, ob.k, count(*) looks, count(oc.k) hits from ob left join oc on oc.run_id=ob.run_id and oc.frame_idx=ob.frame_idx and oc.k=ob.k group by 1,2)"""


def cell_votes(spark, sf) -> DataFrame:
    own = spatial.assign_runs(view(spark, sf, "v_detection"), segs(spark, sf), "event_id", "x", "y")
    occ = own.join(view(spark, sf, "v_detection").select("event_id", "frame_idx"), "event_id").select(
        "run_id", "frame_idx", (F.col("s") - 2.2).alias("s0"), (F.col("s") + 2.2).alias("s1"))
    return intervals.vote_cells(view(spark, sf, "v_run"), spans(spark, sf), occ)


@query("WIN05_vote_cells", f"with {CELLS} select run_id, k, looks, hits, looks>=3 is_observed, looks>=3 and hits*2>looks is_occupied from votes")
def win05(spark, sf):
    return cell_votes(spark, sf)


@query("WIN06_car_intervals", f"with c as (select run_id, s-2.2e0 s0, s+2.2e0 s1 from {OWN_RUN} t), {merged('c', 'run_id', '1.5e0', 'm')} select run_id, round(s0,4) s0, round(s1,4) s1 from m")
def win06(spark, sf):
    pts = spatial.assign_runs(view(spark, sf, "v_detection"), segs(spark, sf), "event_id", "x", "y")
    return intervals.car_intervals(pts, ["run_id"]).select("run_id", r(F.col("s0")).alias("s0"), r(F.col("s1")).alias("s1"))


# Every car, drawn into the first half of its stretch of eight places, so that gaps stay between them.
SPREAD = "floor(s/47.2e0)*47.2e0+(s-floor(s/47.2e0)*47.2e0)*0.4937e0+0.0013e0"
SPREAD_CARS = f"(select run_id, {SPREAD} s from {OWN_RUN} t)"
WIN7 = f"""c as (select run_id, s-2.2e0 s0, s+2.2e0 s1 from {SPREAD_CARS} t), {merged('c', 'run_id', '1.5e0', 'occ')}, {merged(SPAN_OK, 'run_id', '0.0e0', 'obm')},
 ob as (select * from obm union all select run_id, 0.0e0, length_m from v_run where run_id not in (select run_id from obm)), {gaps_sql('occ', 'ob', 'g')}"""


def spread_cars(spark, sf):
    return spatial.assign_runs(view(spark, sf, "v_detection"), segs(spark, sf), "event_id", "x", "y").select("run_id", F.expr(SPREAD).alias("s"))


@query("WIN07_free_gaps", f"with {WIN7} select run_id, round(s0,2) s0, round(s1,2) s1, round(s1-s0,2) len_m, spaces from g where spaces>0")
def win07(spark, sf):
    cars = spread_cars(spark, sf).select("run_id", (F.col("s") - 2.2).alias("s0"), (F.col("s") + 2.2).alias("s1"))
    return intervals.free_gaps(view(spark, sf, "v_run"), cars, spans(spark, sf))[1]


@query("WIN07_free_per_run", f"""with {WIN7}, f as (select run_id, sum(spaces) f from g where spaces>0 group by 1), oc as (select run_id, sum(s1-s0) o from occ group by 1), ol as (select run_id, sum(s1-s0) o from ob group by 1)
 select r.run_id, capacity, cast(least(coalesce(f,0), capacity) as bigint) as "free", coalesce(f,0) > capacity capped, round(coalesce(oc.o,0.0e0),2) occupied_len_m, round(coalesce(ol.o,0.0e0),2) observed_len_m,
 round(coalesce(ol.o,0.0e0)/length_m,3) observed_fraction, round(length_m,2) length_m, round(pitch_m,2) space_m from v_run r left join f using (run_id) left join oc using (run_id) left join ol using (run_id)""")
def win07b(spark, sf):
    cars = spread_cars(spark, sf).select("run_id", (F.col("s") - 2.2).alias("s0"), (F.col("s") + 2.2).alias("s1"))
    return intervals.free_gaps(view(spark, sf, "v_run"), cars, spans(spark, sf))[0]


def summary_sql(cars: str, runs_: str, spans_: str) -> str:
    """CTE chain ending in ``summ`` for cars ``(run_id, s)`` and observed ``spans_`` on the runs of ``runs_``."""
    return f"""{merged(spans_, 'run_id', '0.0e0', 'obm')},
 ob as (select * from obm union all select run_id, 0.0e0, length_m from {runs_} where run_id not in (select run_id from obm)),
 on_ as (select c.run_id, c.s from {cars} c where exists (select 1 from ob o where o.run_id=c.run_id and o.s0 <= least(c.s, 230.1e0-1e-9) and least(c.s, 230.1e0-1e-9) < o.s1)),
 iv as (select run_id, s-2.2e0 s0, s+2.2e0 s1 from on_), {merged('iv', 'run_id', '1.5e0', 'occ')}, {gaps_sql('occ', 'ob', 'g')},
 f as (select run_id, sum(spaces) f from g where spaces>0 group by 1), ol as (select run_id, sum(s1-s0) o from ob group by 1), ca as (select run_id, count(*) a from {cars} c group by 1), co as (select run_id, count(*) o from on_ group by 1),
 summ as (select r.run_id, r.capacity, cast(least(round_even(ol.o/pitch_m,0), capacity) as bigint) capacity_observed, coalesce(co.o,0) cars, coalesce(ca.a,0)-coalesce(co.o,0) cars_off_observed,
 cast(least(coalesce(f,0), capacity, least(round_even(ol.o/pitch_m,0), capacity)) as bigint) as "free", cast(greatest(0, least(round_even(ol.o/pitch_m,0), capacity)-coalesce(co.o,0)) as bigint) free_by_subtraction,
 round(ol.o/length_m,3) observed_fraction from {runs_} r left join f using (run_id) left join ol using (run_id) left join ca using (run_id) left join co using (run_id))"""


KEEP = ["run_id", "capacity", "capacity_observed", "cars", "cars_off_observed", "free", "free_by_subtraction", "observed_fraction"]


@query("WIN08_run_summary", f"with {summary_sql(SPREAD_CARS, 'v_run', SPAN_OK)} select * from summ")
def win08(spark, sf):
    return intervals.run_summary(view(spark, sf, "v_run"), spread_cars(spark, sf), spans(spark, sf))[0].select(*KEEP)


def clustered(src: str, by: str, view_col: str, out: str) -> str:
    """Recursive CTE chain: single-link components of ``src`` (``id, x, y``) within 2 m, per ``by``."""
    return f"""{out}_p as (select * from {src}), {out}_e as (select a.id a, b.id b from {out}_p a join {out}_p b on a.{by} is not distinct from b.{by} and a.id<>b.id
 and abs(a.x-b.x)<=2.0e0 and abs(a.y-b.y)<=2.0e0 and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 4.0e0),
 {out}_r(id, root) as (select id, id from {out}_p union select e.b, r.root from {out}_r r join {out}_e e on e.a=r.id and e.b>r.root),
 {out}_l as (select id, min(root) label from {out}_r group by 1),
 {out} as (select {by}, label, avg(x) x, avg(y) y, count(*) members, count(distinct {view_col}) views from {out}_p join {out}_l using (id) group by {by}, label having count(distinct {view_col}) >= 2)"""


@query("CLU01_cluster_points", f"""with recursive {clustered("(select event_id id, x, y, frame_idx, 0 one from v_detection)", 'one', 'frame_idx', 'cl')} select round(x,9) x, round(y,9) y, members, views from cl""")
def clu01(spark, sf):
    pts = view(spark, sf, "v_detection").select("event_id", "x", "y", F.col("frame_idx").alias("view"))
    return components.cluster_points(pts).select(r(F.col("x"), 9).alias("x"), r(F.col("y"), 9).alias("y"), "members", "views")


@query("AGG39_view_scatter", f"""with recursive {clustered("(select event_id id, x, y, frame_idx, 0 one from v_detection)", 'one', 'frame_idx', 'cl')},
 d as (select sqrt(avg(pow(p.x-c.x,2)+pow(p.y-c.y,2))) s from cl c join cl_l l using (label) join cl_p p using (id) where c.views>=3 group by label),
 k as (select s, row_number() over (order by s) - 1 i, count(*) over () n from d)
 select max(n) clusters, round(max(case when i=n//2 then s end),4) median_m, round(max(case when i=round_even((n-1)*0.9e0,0) then s end),4) p90_m from k""")
def agg39(spark, sf):
    from ..operators.reports import view_scatter
    pts = view(spark, sf, "v_detection").select("event_id", "x", "y", F.col("frame_idx").alias("view"))
    out = view_scatter(pts)
    return out.select("clusters", r(F.col("median_m")).alias("median_m"), r(F.col("p90_m")).alias("p90_m"))


@query("CLU02_chain_bays", """with s as (select *, case when ord - lag(ord) over w = 1 or (ord - lag(ord) over w)*5.9e0 <= 9.0e0 then 0 else 1 end brk, floor(ord/40) row from v_bay window w as (partition by floor(ord/40) order by ord)),
 i as (select *, sum(brk) over (partition by row order by ord) isle from s) select bay_id, min(ord) over (partition by row, isle) label from i""")
def clu02(spark, sf):
    return runs.chain_bays(bays_u(spark, sf))


BUILT = """s as (select *, case when (ord - lag(ord) over w)*5.9e0 <= 9.0e0 then 0 else 1 end brk, floor(ord/40) row from v_bay window w as (partition by floor(ord/40) order by ord)),
 i as (select *, sum(brk) over (partition by row order by ord) isle from s), m as (select *, min(ord) over (partition by row, isle) label from i)"""


@query("CLU03_build_runs", f"""with {BUILT}, n as (select label, zona, count(*) c from m group by 1,2), z as (select label, zona from (select *, row_number() over (partition by label order by c desc, zona) rn from n) t where rn=1),
 k as (select label, park_txt, count(*) c from m group by 1,2), p as (select label, park_txt from (select *, row_number() over (partition by label order by c desc, park_txt) rn from k) t where rn=1)
 select concat('run_', cast(label as varchar)) run_id, min(street) street, any_value(z.zona) zona, any_value(p.park_txt) park_txt, count(*) capacity, case when count(*)>1 then 5.9e0 end pitch_m,
 round(case when count(*)>1 then max(x)-min(x)+5.9e0 else 0.0e0 end,2) length_m, 0.0e0 bearing_deg, count(*)>=4 verified from m join z using (label) join p using (label) group by label""")
def clu03(spark, sf):
    b = bays_u(spark, sf)
    return runs.build_runs(b, runs.chain_bays(b))[0].drop("label")


@query("CLU03_members", f"""with {BUILT} select concat('run_', cast(label as varchar)) run_id, row_number() over (partition by label order by ord) seq, bay_id,
 round(x - min(x) over (partition by label) + case when count(*) over (partition by label) > 1 then 2.95e0 else 0.0e0 end, 3) s from m""")
def clu03b(spark, sf):
    b = bays_u(spark, sf)
    return runs.build_runs(b, runs.chain_bays(b))[1].select("run_id", "seq", "bay_id", r(F.col("s"), 3).alias("s"))


@query("CLU03_run_lines", f"""with {BUILT}, e as (select label, count(*) n, min(x) x0, max(x) x1, min(y) y from m group by label)
select concat('run_', cast(label as varchar)) run_id, cast(n as int) points, round(x0 - h, 3) x0, round(y, 3) y0, round(x1 + h, 3) x1 from (select *, case when n>1 then 2.95e0 else 0.0e0 end h from e) t""")
def clu03c(spark, sf):
    b = bays_u(spark, sf)
    out, members = runs.build_runs(b, runs.chain_bays(b))
    line = runs.run_lines(members, out)
    return line.select("run_id", F.size("line").alias("points"), *[r(F.get("line", at)[c], 3).alias(n) for n, at, c in (("x0", F.lit(0), "x"), ("y0", F.lit(0), "y"), ("x1", F.size("line") - 1, "x"))])


MISSION = "concat('m', cast(cast(floor((day(observed_at)-1)/5) as bigint) as varchar))"


@query("WIN09_recompute_run_states", f"""with recursive sp as (select *, {MISSION} mid from {SPAN_OK} t where observed_at > {CUT}),
 nm as (select run_id, mid from (select *, row_number() over (partition by run_id order by observed_at desc, event_id desc) rn from sp) t where rn=1),
 mine as (select d.event_id id, d.run_id, d.x, d.y, d.frame_idx from {OWN_RUN} d join nm on nm.run_id=d.run_id and {MISSION.replace('observed_at', 'd.observed_at')}=nm.mid where d.observed_at > {CUT}),
 seen as (select sp.* from sp join nm using (run_id, mid)), live as (select r.* from v_run r join nm using (run_id)),
 {clustered('mine', 'run_id', 'frame_idx', 'cl')},
 cn as (select run_id, round(x,9) x, round(y,9) y from cl),
 cars as (select run_id, least(greatest(x,0.0e0),length_m) s from cn join v_run r using (run_id) where sqrt(pow(x-least(greatest(x,0.0e0),length_m),2)+pow(cn.y-r.y,2)) <= 6.0e0),
 {summary_sql('cars', 'live', 'seen')} select summ.*, nm.mid mission_id from summ join nm using (run_id)""")
def win09(spark, sf):
    dets = view(spark, sf, "v_detection")
    own = spatial.assign_runs(dets, segs(spark, sf), "event_id", "x", "y").select("event_id", "run_id")
    per, _ = runs.recompute_run_states(mission(dets.join(own, "event_id")), mission(spans(spark, sf)), view(spark, sf, "v_run"), segs(spark, sf), AS_OF, WINDOW_S)
    return per.select(*KEEP, "mission_id")


@query("WIN12_bay_slots", """select concat('run_', cast(floor(ord/40) as bigint)) run_id, bay_id, round((row_number() over w - 1)*5.9e0,4) s0, round(row_number() over w*5.9e0,4) s1 from v_bay window w as (partition by floor(ord/40) order by ord)""")
def win12(spark, sf):
    b = view(spark, sf, "v_bay").withColumn("run_id", F.concat(F.lit("run_"), F.floor(F.col("ord") / 40).cast("string")))
    listed = b.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "bay_id"))), lambda e: e.bay_id).alias("bay_ids"))
    return runs.bay_slots(listed.withColumn("pitch_m", F.lit(5.9))).select("run_id", "bay_id", r(F.col("s0")).alias("s0"), r(F.col("s1")).alias("s1"))


@query("WIN13_segments", """with seg as (select run_id, unnest(range(13)) seg, length_m from v_run) select run_id, cast(seg as int) seg, round(seg*(length_m/13),4) a, round((seg+1)*(length_m/13),4) b from seg""")
def win13(spark, sf):
    return intervals.segments(view(spark, sf, "v_run")).select("run_id", "seg", r(F.col("a")).alias("a"), r(F.col("b")).alias("b"))


@query("WIN14_shift_lateral", """select run_id, i vertex, round(case i when 0 then 0.0e0 when 1 then 100.3e0 else 230.1e0 end,4) x, round(y+1.25e0,4) y from v_run, (select cast(unnest([0,1,2]) as int) i) t""")
def win14(spark, sf):
    moved = lines(spark, sf).select("run_id", runs.shift_lateral(F.col("line"), F.lit(1.25)).alias("line"))
    return geometry.vertices(moved, "line", "vertex", "p").select("run_id", "vertex", r(F.col("p.x")).alias("x"), r(F.col("p.y")).alias("y"))


@query("WIN15_nearest_gap", f"""with {WIN7}, t as (select g.run_id, concat(g.run_id,'@',cast(round(g.s0,2) as varchar)) target, (round(g.s0,2)+round(g.s1,2))/2 s, r.y from g join v_run r on r.run_id=g.run_id where spaces>0),
 d as (select b.bay_id, t.*, sqrt(pow(b.x-least(t.s,230.1e0),2)+pow(b.y-t.y,2)) dist, row_number() over (partition by b.bay_id order by sqrt(pow(b.x-least(t.s,230.1e0),2)+pow(b.y-t.y,2)), target) rn from v_bay b, t)
 select bay_id point_id, run_id, round(s,3) s, round(dist,3) dist from d where rn=1""")
def win15(spark, sf):
    cars = spread_cars(spark, sf).select("run_id", (F.col("s") - 2.2).alias("s0"), (F.col("s") + 2.2).alias("s1"))
    per, gaps = intervals.free_gaps(view(spark, sf, "v_run"), cars, spans(spark, sf))
    pts = view(spark, sf, "v_bay").select(F.col("bay_id").alias("point_id"), "x", "y")
    out = runs.nearest_gap(pts, gaps, per, lines(spark, sf))
    return out.select("point_id", "run_id", r(F.col("s"), 3).alias("s"), r(F.col("dist"), 3).alias("dist"))


@query("WIN15_gap_still_free", f"""with {WIN7}, gg as (select run_id, round(s0,2) s0, round(s1,2) s1 from g where spaces>0), t as (select event_id point_id, concat('run_', cast(user_id//40 as varchar)) run_id, (event_id%240)*1.0e0+0.013e0 s from events)
 select point_id, t.run_id, case when r.run_id is null then true else exists (select 1 from gg where gg.run_id=t.run_id and gg.s0<=t.s and t.s<=gg.s1) end still_free from t left join v_run r using (run_id)""")
def win15b(spark, sf):
    cars = spread_cars(spark, sf).select("run_id", (F.col("s") - 2.2).alias("s0"), (F.col("s") + 2.2).alias("s1"))
    per, gaps = intervals.free_gaps(view(spark, sf, "v_run"), cars, spans(spark, sf))
    t = spark.sql(f"select event_id point_id, concat('run_', cast(floor(user_id/40) as string)) run_id, (event_id%240)*1.0e0+0.013e0 s from parquet.`{sf}/events.parquet`")
    return runs.gap_still_free(t, gaps, per)


LAYER = f"""with {CELLS}, vo as (select run_id, k*0.5e0 s0, least((k+1)*0.5e0,230.1e0) s1 from votes where looks>=3 and hits*2>looks), vb as (select run_id, k*0.5e0 s0, least((k+1)*0.5e0,230.1e0) s1 from votes where looks>=3),
 {merged('vo', 'run_id', '1.5e0', 'occ')}, {merged('vb', 'run_id', '0.0000001e0', 'obs')}, {gaps_sql('occ', 'obs', 'g')}, f as (select run_id, sum(spaces) f from g where spaces>0 group by 1),
 ol as (select run_id, sum(s1-s0) o from obs group by 1), ocl as (select run_id, sum(s1-s0) o from occ group by 1), n as (select run_id, count(*) n from {OWN_RUN} t group by 1)
 select r.run_id, capacity, cast(least(coalesce(f,0),capacity) as bigint) as "free", round(coalesce(ocl.o,0.0e0),2) occupied_len_m, coalesce(n,0) dets_seen, round(ol.o/length_m,3) observed_fraction,
 coalesce(n,0)>0 and round(coalesce(ocl.o,0.0e0),2)=0 outvoted from v_run r join ol using (run_id) left join f using (run_id) left join ocl using (run_id) left join n using (run_id) where round(ol.o/length_m,3) > 0.05"""


@query("AGG41_run_layer_report", LAYER)
def agg41(spark, sf):
    own = spatial.assign_runs(view(spark, sf, "v_detection"), segs(spark, sf), "event_id", "x", "y")
    return runs.run_layer_report(view(spark, sf, "v_run"), cell_votes(spark, sf), own)


@query("AGG41_layer_totals", f"""with t as ({LAYER}) select count(*) runs, cast(coalesce(sum(capacity),0) as bigint) capacity, cast(coalesce(sum("free"),0) as bigint) "free", cast(coalesce(sum(dets_seen),0) as bigint) dets_seen, count(case when outvoted then 1 end) outvoted from t""")
def agg41b(spark, sf):
    return runs.layer_totals(agg41(spark, sf))


@query("CLU05_street_graph", """with s as (select cast(user_id%40 as bigint) a, cast(least(39, user_id%40+1+event_id%2) as bigint) b, cast(user_id//40 as bigint) y, event_id from events), e as (select y*40+least(a,b) u, y*40+greatest(a,b) v, abs(b-a)*5.9e0 len from s where a<>b),
 m as (select u, v, min(len) len from e group by 1,2), d as (select n, count(*) deg from (select u n from m union all select v from m) t group by 1)
 select (select count(*) from d) nodes, (select count(*) from m) edges, (select count(*) from d where deg%2=1) odd_nodes, (select max(deg) from d) max_degree, (select round(sum(len),3) from m) length_m""")
def clu05(spark, sf):
    from ..operators.reports import graph_summary, street_graph
    e = spark.sql(f"""select event_id id, (user_id%40)*5.9e0+0.1e0 ax, floor(user_id/40)*12.1e0 ay, least(39, user_id%40+1+event_id%2)*5.9e0+0.1e0 bx, floor(user_id/40)*12.1e0 by_ from parquet.`{sf}/events.parquet`""")
    nodes, edges = street_graph(e.withColumnRenamed("by_", "by"))
    return graph_summary(nodes, edges).withColumn("length_m", r(F.col("length_m"), 3))


@query("CLU05_components", """with recursive s as (select cast(user_id%40 as bigint) a, cast(least(39, user_id%40+1+event_id%2) as bigint) b, cast(user_id//40 as bigint) y from events), e as (select distinct y*40+a u, y*40+b v from s where a<>b),
 bth as (select u,v from e union select v,u from e), r(n, root) as (select distinct u, u from bth union select b.v, r.root from r join bth b on b.u=r.n and b.v>r.root), l as (select n, min(root) c from r group by 1)
 select count(*) nodes, count(distinct c) components from l""")
def clu05b(spark, sf):
    from ..operators.reports import street_graph
    e = spark.sql(f"""select event_id id, (user_id%40)*5.9e0+0.1e0 ax, floor(user_id/40)*12.1e0 ay, least(39, user_id%40+1+event_id%2)*5.9e0+0.1e0 bx, floor(user_id/40)*12.1e0 by_ from parquet.`{sf}/events.parquet`""")
    nodes, edges = street_graph(e.withColumnRenamed("by_", "by"))
    lab = components.connected_components(nodes.select(F.col("node").alias("id")), edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    return lab.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("label").alias("components"))


