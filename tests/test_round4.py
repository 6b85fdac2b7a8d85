"""What went through the driver, and results on larger tables."""

import math
from contextlib import contextmanager

from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators import geometry, reports, runs, spatial
from kerbline.sources import documents, frames


@contextmanager
def broadcasts_below(spark, size):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def ran(df):
    """The plan as it was carried out, and the number of rows."""
    n = len(df.collect())
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0], n


def grid(spark, n, x="x", y="y", at=0.0):
    return spark.range(n).select((F.col("id") % 500 * 7.0 + at).alias(x), (F.floor(F.col("id") / 500) * 7.0 + at).alias(y))


def test_a_side_that_generators_multiply_is_not_broadcast(spark):
    """By the bytes they are made from both sides would be sent to all; the rows that come of them would not."""
    with broadcasts_below(spark, "2m"):
        points, items = grid(spark, 100_000), grid(spark, 20_000, "qx", "qy", 1e6)
        plan, n = ran(spatial.near_pairs(points, items, "x", "y", ("qx", "qy", "qx", "qy"), 3.0, 2.0))
        assert "BroadcastHashJoin" not in plan and n == 0
        boxes = items.select(F.col("qx").alias("x0"), F.col("qy").alias("y0"), (F.col("qx") + 30).alias("x1"), (F.col("qy") + 30).alias("y1"))
        plan, n = ran(spatial.points_in_boxes(points, boxes, "x", "y", ("x0", "y0", "x1", "y1"), 2.0))
        assert "BroadcastHashJoin" not in plan and n == 0


def test_grid_joins_find_each_pair_once(spark):
    points, items = grid(spark, 2000).withColumn("p", F.monotonically_increasing_id()), grid(spark, 1000, "qx", "qy", 1.0)
    got = spatial.near_pairs(points, items, "x", "y", ("qx", "qy", "qx", "qy"), 3.0).filter("abs(x - qx) <= 3 and abs(y - qy) <= 3")
    assert got.count() == got.select("p", "qx", "qy").distinct().count() == 1000


def test_outlines_that_are_paired_are_merged(spark):
    """Each outline has a row on all sides, so none of them is sent to all."""
    bays = grid(spark, 400).withColumn("bay_id", F.concat_ws("-", "x", "y"))
    ring = F.array(*[F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in ((-2, -1), (2, -1), (2, 1), (-2, 1))])
    out = reports.pair_by_position(bays.withColumn("ring", ring), bays.withColumnRenamed("bay_id", "other_id"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 2
    assert [tuple(r) for r in out.groupBy("dist", "same_id").count().collect()] == [(0.0, True, 400)]


def test_a_gap_of_exactly_so_many_places_counts_by_the_mean(spark):
    """The place along the kerb is the mean of the looks to the last bit, not that of a sum of parts of the line."""
    length = 39 * 5.9
    cases = [("r0", 1.4, 21.8), ("r1", 4.5, 42.6), ("r2", 5.2, 25.6), ("r3", 5.9, 14.5), ("r4", length + 1.0, length - 5.9)]
    kerbs = spark.createDataFrame([(k, 40, 5.9, length, 12.1) for k, _, _ in cases], "run_id string, capacity bigint, pitch_m double, length_m double, y double")
    lines = kerbs.withColumn("line", F.array(geo.point(F.lit(0.0), "y"), geo.point(F.lit(100.3), "y"), geo.point("length_m", "y")))
    seen = F.expr("timestamp_ntz '2024-01-30 00:00:00'").alias("observed_at")
    mark = [F.lit("m").alias("mission_id"), seen]
    dets = spark.createDataFrame([(i, k, x, 12.1) for k, x, _ in cases for i in (1, 2)], "frame_idx int, run_id string, x double, y double").select("*", *mark)
    spans = spark.createDataFrame([(i, k, 1, 0.0, b) for i, (k, _, b) in enumerate(cases)], "event_id bigint, run_id string, frame_idx int, s0 double, s1 double").select("*", *mark)
    per, _ = runs.recompute_run_states(dets, spans, kerbs, spatial.polyline_segments(lines, "run_id", "line"), "2024-01-31 00:00:00", 950400)
    got = {r.run_id: (r.cars + r.cars_off_observed, r.free) for r in per.collect()}
    gap = {k: math.floor((b - (x + 2.2) - 0.5) / 5.9) for k, x, b in cases[:4]}
    assert gap == {"r0": 2, "r1": 5, "r2": 3, "r3": 0}
    assert {k: got[k] for k in gap} == {k: (1, n) for k, n in gap.items()} and got["r4"] == (1, 38)


def test_a_label_line_is_cut_once(spark):
    want = {"0 0.5 0.5 0.1": ["field count"], "": ["field count"], "0 a 0.5 0.1 0.1": ["not numeric"], "0.0 0.5 0.5 0.1 0.1": ["not numeric"], "1 0.5 0.5 0.1 0.1": ["class"],
            "0 0.5 0.5 0 0.1": ["zero area"], "0 0.5 0.5 0.6 0.1": ["size"], " 0  0.5\t0.5 0.1 0.1 ": [], "2 -0.1 1.5 0.9 2": ["class", "cx range", "cy range", "h range", "outside image", "size"],
            "0 0.02 0.5 0.1 0.1": ["outside image"], "99999999999 0.5 0.5 0.1 0.1": ["not numeric"], None: []}
    out = geometry.validate_labels(spark.createDataFrame([(k,) for k in want], "line string"), "line")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "Filter (size" not in plan
    got = {}
    for r in out.collect():
        got.setdefault(r.line, []).append(r.problem)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_detections_are_merged_and_small_documents_share_tasks(spark, tmp_path):
    """Neither keys nor detections are sent to all, and the driver does not keep account of a task per small document."""
    for k in range(30):
        (tmp_path / f"{k}.json").write_text('{"%d": [{"box": [1, 2, 3, %d], "conf": 0.5}]}' % (k, k))
    parts = documents.read_elements(spark, str(tmp_path), frames._CACHES)
    assert parts.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions")) and parts.count() == 30
    poses = spark.range(40).select(F.col("id").alias("frame_idx"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("video_frame"))
    got = frames.detections_for(poses, frames.read_detections(spark, str(tmp_path)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 2 and "MapInPandas" not in plan
    assert sorted((r.frame_idx, r.y1) for r in got.collect()) == [(k, float(k)) for k in range(30)]


def test_found_items_are_merged_with_their_points(spark):
    points, items = grid(spark, 600).withColumn("p", F.monotonically_increasing_id()), grid(spark, 300, "ix", "iy").withColumn("i", F.monotonically_increasing_id())
    out = spatial.nearest(points, items, "p", "i", "x", "y", "ix", "iy", size=3.0)
    assert "strategy=merge" in out._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]
    # one row of places has an item each, of the next every place has its nearest right below
    got = {r.p: r.dist for r in out.collect()}
    assert len(got) == 600 and sum(d == 0 for d in got.values()) == 300
