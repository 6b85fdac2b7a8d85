"""Views that give the parquet tables the shapes of a parking survey.

One text serves both engines: ``{k}`` and the ``later()`` marker are the only spellings that differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the fixture: evaluation time and vote window in seconds.
AS_OF = "2024-01-31 00:00:00"
WINDOW_S = 950400

_EV = "(select *, cast({k} as int) as k from events)"

VIEWS: dict[str, str] = {
    "v_bay": """select cast(c_custkey as string) bay_id, c_custkey ord, c_mktsegment zona,
 concat('street ', cast(cast(floor(c_custkey/40) as bigint) as string)) street,
 case when c_custkey%11=0 then 'perpendicular' when c_custkey%11=5 then 'angled' else 'parallel' end park_txt,
 c_custkey%7<>0 is_public, (c_custkey%40)*5.9e0 x, floor(c_custkey/40)*12.1e0 y
 from customer""",
    "v_observation": f"""select event_id, cast(user_id as string) bay_id, value>35.0e0 occupied, cast(event_id%200 as int) frame_idx,
 case when event_id%17=0 then null else concat('f',cast(cast(floor(event_id/3) as bigint) as string)) end frame_id,
 case when event_id%19=0 then null else concat('m',cast(cast(floor((day(ts)-1)/5) as bigint) as string)) end mission_id,
 case when k%10<3 then null else value>40.0e0 end gt, case when k%2=0 then 'heuristic' else 'detector' end backend,
 concat('a',cast(user_id%3 as string)) survey_area, concat('d',cast(user_id%5 as string)) drone_id, ts observed_at
 from {_EV}""",
    "v_detection": f"""select event_id, cast(event_id%200 as int) frame_idx, (user_id%40)*5.9e0+((k%10)-4.5e0)*0.35e0 x,
 floor(user_id/40)*12.1e0+(floor(k/10)-4.5e0)*0.3e0 y, value/(value+20.0e0) conf, ts observed_at
 from {_EV} where event_type in ('view','click')""",
    "v_span": f"""select event_id, concat('run_',cast(cast(floor(user_id/40) as bigint) as string)) run_id, cast(event_id%200 as int) frame_idx,
 greatest(0.0e0,(user_id%40)*5.9e0-6.0e0) s0, (user_id%40)*5.9e0+3.0e0+k*0.2e0 s1, ts observed_at
 from {_EV} where event_type='purchase'""",
    "v_job": f"""select event_id frame_id, case when k<70 then 'processed' when k<85 then 'queued' when k<95 then 'running' else 'failed' end status,
 ts enqueued_at, case when k<70 or k>=95 then later(ts, floor(value)) end finished_at,
 case when k>=85 and k<95 then later(ts, 300) end lease_expires_at,
 case when k%2=0 then cast(k%5 as int) end unassigned_dets, case when k%2=0 then cast(k%3 as int) end unassigned_near
 from {_EV}""",
    "v_frame": """select concat('g',cast(event_id as string)) frame_id, concat('d',cast(user_id%5 as string)) drone_id,
 case when event_id%9=0 then null else concat('m',cast(cast(floor((day(ts)-1)/5) as bigint) as string)) end mission_id,
 concat('a',cast(user_id%3 as string)) survey_area, cast(event_id%400 as int) frame_idx, ts received_at from events""",
    "v_gt_box": """select l_orderkey%500 frame, l_orderkey*10+l_linenumber box_id, (l_partkey%20)*90.0e0 x0,
 (cast(floor(l_partkey/20) as bigint)%10)*100.0e0 y0, (l_partkey%20)*90.0e0+80.0e0 x1,
 (cast(floor(l_partkey/20) as bigint)%10)*100.0e0+60.0e0 y1 from lineitem""",
    "v_det_box": """select l_orderkey%500 frame, l_orderkey*10+l_linenumber box_id, (l_partkey%20)*90.0e0+(l_quantity-25.0e0)*2 x0,
 (cast(floor(l_partkey/20) as bigint)%10)*100.0e0 y0, (l_partkey%20)*90.0e0+80.0e0+(l_quantity-25.0e0)*2 x1,
 (cast(floor(l_partkey/20) as bigint)%10)*100.0e0+60.0e0 y1, 1.0e0-l_discount*5 conf
 from lineitem""",
    # bay state as stored: one row per bay, some stale, some without a verdict
    "v_state": """select bay_id, case when cast(bay_id as int)%10=9 then null else 2*occ>n end occupied,
 greatest(occ,n-occ)/cast(n as double) confidence, earlier_days(seen, cast(bay_id as int)%15) updated_at,
 'vision' source, backend, last_frame
 from (select bay_id, count(*) n, count(case when occupied then 1 end) occ, max(observed_at) seen, max(backend) backend,
 max(frame_idx) last_frame from v_observation group by bay_id) t""",
    # one kerb per row of bays
    "v_run": """select concat('run_',cast(cast(floor(ord/40) as bigint) as string)) run_id, street, floor(ord/40)*12.1e0 y, count(*) capacity,
 5.9e0 pitch_m, 39*5.9e0 length_m from v_bay group by 1, 2, 3""",
    "v_closure": """select * from (values
 ('c1', 3.0e0, 5.0e0, 60.0e0, 30.0e0, null, null),
 ('c2', 50.0e0, 20.0e0, 130.0e0, 60.0e0, timestamp_ntz '2024-01-10 00:00:00', timestamp_ntz '2024-03-01 00:00:00'),
 ('c3', 20.0e0, 40.0e0, 90.0e0, 80.0e0, timestamp_ntz '2024-01-05 00:00:00', null),
 ('c4', 100.0e0, 0.5e0, 200.0e0, 90.0e0, timestamp_ntz '2023-12-01 00:00:00', timestamp_ntz '2024-01-31 00:00:00'),
 ('c5', 0.5e0, 100.0e0, 120.0e0, 200.0e0, timestamp_ntz '2024-02-01 00:00:00', null))
 as t(closure_id, x0, y0, x1, y1, valid_from, valid_to)""",
    # a camera above every bay, turned by a different angle each
    "v_pose": """select cast(ord as int) frame_idx, x, y, 30.0e0 alt, radians((ord%100)*3.6e0) yaw from v_bay""",
    # street centre lines, one straight piece per row of bays, 4 m south of it
    "v_road": """select concat('r',cast(cast(floor(ord/40) as bigint) as string)) osm_id,
 case when floor(ord/40)%3=0 then null else street end name,
 -10.0e0 ax, floor(ord/40)*12.1e0-4.0e0 ay, 250.0e0 bx, floor(ord/40)*12.1e0-4.0e0+(floor(ord/40)%3)*0.4e0 by_
 from (select distinct cast(floor(ord/40) as bigint)*40 ord, street from v_bay) t""",
    # outlines: each bay's rectangle, turned by a few degrees
    "v_ring": """select bay_id, ord, zona, street, park_txt, x, y, deg, l, w, cos(radians(deg+turn)) c, sin(radians(deg+turn)) s
 from (select *, (ord%7)*3.0e0+1.0e0 deg, case park_txt when 'perpendicular' then 90.0e0 when 'angled' then 45.0e0 else 0.0e0 end turn,
 case park_txt when 'perpendicular' then 4.8e0 else 5.4e0 end l, case park_txt when 'perpendicular' then 2.4e0 else 2.2e0 end w from v_bay) t""",
    # ordered positions of many flights
    "v_track": """select concat('u',cast(user_id%50 as string)) flight, event_id idx, ts t,
 (user_id%40)*5.9e0+event_id%31 x, floor(event_id/50)*1.5e0+k*0.02e0 y, value, k from (select *, cast({k} as int) as k from events)""",
}


def _deps(name: str) -> list[str]:
    """Views a text needs, dependencies first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for dep in re.findall(r"\bv_[a-z_]+\b", text):
            if dep in VIEWS and dep not in out:
                visit(VIEWS[dep])
                if dep not in out:
                    out.append(dep)

    visit(name)
    return out


def _spark_text(sql: str) -> str:
    sql = sql.replace("{k}", "get_json_object(props,'$.k')")
    sql = re.sub(r"later\((\w+), ", r"_later(\1, ", sql)
    sql = re.sub(r"_later\((\w+), ((?:floor\(value\))|\d+)\)", r"(\1 + make_dt_interval(0,0,0,cast(\2 as decimal(18,6))))", sql)
    return re.sub(r"earlier_days\((\w+), ([^,]*?%15)\)", r"(\1 - make_dt_interval(\2))", sql)


def duck_text(sql: str) -> str:
    sql = sql.replace("{k}", "json_extract_string(props,'$.k')").replace("timestamp_ntz '", "timestamp '")
    sql = re.sub(r"later\((\w+), ((?:floor\(value\))|\d+)\)", r"(\1 + to_milliseconds(cast((\2)*1000 as bigint)))", sql)
    return re.sub(r"earlier_days\((\w+), ([^,]*?%15)\)", r"(\1 - to_days(\2))", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view over the parquet files in ``sf_dir``."""
    order = _deps(name)
    ctes = ", ".join(f"{v} as ({_spark_text(VIEWS[v])})" for v in order)
    sql = f"with {ctes} select * from {name}"
    for table in ("customer", "events", "lineitem"):
        sql = re.sub(rf"\bfrom {table}\b", f"from parquet.`{sf_dir}/{table}.parquet`", sql)
    return spark.sql(sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(sql: str) -> str:
    """Prefix a SQL text with the views it mentions."""
    used = _deps(sql)
    body = duck_text(sql).strip()
    if not used:
        return body
    ctes = ", ".join(f"{v} as ({duck_text(VIEWS[v])})" for v in used)
    m = re.match(r"with\s+(recursive\s+)?", body, re.I)
    if m:
        return f"with {m.group(1) or ''}{ctes}, {body[m.end():]}"
    return f"with {ctes} {body}"
