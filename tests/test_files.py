"""Readers and writers on small files written here."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbline.functions import geo, text
from kerbline.operators import images
from kerbline.sources import documents, features, frames, sinks


def put(path, doc):
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc), encoding="utf-8")
    return str(path)


def test_feature_collection_file(spark, tmp_path):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0], [0.0, 0.0]]

    def f(i, zona, kind="Polygon", bearing=12.5):
        return {"type": "Feature", "properties": {"id": i, "zona": zona, "mestopoloz": " ", "vid_txt_20": text.PUBLIC_ZONE, "bearing_deg": bearing}, "geometry": {"type": kind, "coordinates": [ring] if kind == "Polygon" else [1.0, 2.0]}}

    p = put(tmp_path / "bays.geojson", {"type": "FeatureCollection", "features": [f(1, "-"), f(2, "z", bearing="n/a"), f(1, "later"), f(3, "q", "Point"), f(None, "q")]})
    got = {r.bay_id: r for r in features.load_bays(features.read_features(spark, p, "Polygon", features.BAY_PROPS, whole_files=True)).collect()}
    assert set(got) == {"1", "2"} and got["1"].zona == "later" and got["1"].bearing_deg == 12.5 and got["2"].bearing_deg is None
    assert got["1"].street is None and got["1"].is_public and (got["1"].x, got["1"].y) == (2.0, 1.0)


def document(df):
    return json.loads("\n".join(r.value for r in df.orderBy("n").collect()))


def test_feature_collection_document(spark, tmp_path):
    empty = spark.createDataFrame([], "id int, ring array<struct<x:double,y:double>>")
    assert document(sinks.to_feature_collection(empty, "Polygon", "ring", ["id"])) == {"type": "FeatureCollection", "features": []}
    df = spark.range(50).select("id", F.array(geo.point(F.lit(1.0), F.lit(2.0))).alias("p"))
    assert sorted(f["properties"]["id"] for f in document(sinks.to_feature_collection(df, "Point", "p", ["id"]))["features"]) == list(range(50))
    path = tmp_path / "doc"
    sinks.write_feature_collection(df, str(path), "Point", "p", ["id"])
    assert len(json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))["features"]) == 50


HARD = [{"type": "Feature", "properties": {"id": i, "zona": z}, "geometry": {"type": "Point", "coordinates": [i + 0.5, -i]}} for i, z in enumerate(
    ["plain", 'a "quoted" ]} name', "back\\slash\\", "\\\"", "[{", "}]", "ж" * 40, "", '{"features":[{"id":9}]}', '"features":[{', "x" * 500] * 3)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_elements_of_any_cut(tmp_path, size, ascii_only, monkeypatch):
    """Whatever the ranges, the elements of the wanted list come out once each."""
    doc = {"note": {"features": [{"no": 1}]}, "skip": [[{"no": 2}]], "features": HARD, "after": [{"no": 3}, "]}"], "a\"b": {"c": []}}
    p = put(tmp_path / "d.json", json.dumps(doc, ensure_ascii=ascii_only, indent=None if size % 2 else 1))
    data = open(p, "rb").read()
    rows = []
    for a in range(0, len(data), size):
        base = max(0, a - documents.NAME_BYTES)
        buf = data[base:a + size]
        rows.append((p, a, min(len(data), a + size), *documents.brackets(buf, a - base, False), *documents.brackets(buf, a - base, True)))
    at = documents._carry(pd.DataFrame(rows[::-1], columns="path start stop out_ends out_closed out_opened in_ends in_closed in_opened".split()))
    with documents.open_file(p) as f:
        got = [json.loads(v) for r in at.itertuples() for _, _, v in documents.elements(f, r.start, r.stop, r.inside, r.stack, {("{", "[features"): "{"})]
    assert got == HARD


def test_large_collection_is_read_by_many_tasks(spark, tmp_path):
    put(tmp_path / "a.json", {"features": HARD * 40})
    put(tmp_path / "b.json", {"type": "FeatureCollection", "features": []})
    put(tmp_path / "c.json", "")
    parts = documents.read_elements(spark, str(tmp_path), {("{", "[features"): "{"}, range_bytes=20_000)
    assert sorted(json.loads(r.value)["properties"]["id"] for r in parts.collect()) == sorted(f["properties"]["id"] for f in HARD * 40)
    assert parts.rdd.getNumPartitions() > 10 and parts.select("path", F.spark_partition_id().alias("t")).distinct().count() > 5


def test_detection_caches_of_three_forms(spark, tmp_path):
    a, b, c = tmp_path / "a", tmp_path / "b", tmp_path / "c"
    for d in (a, b, c):
        d.mkdir()
    one, two = {"box": [0, 1, 2, 3], "conf": 0.5}, {"box": [4, 5, 6, 7], "conf": 0.25}
    put(a / "x.json", {"frames": {"f_1": [one, two], "f\"2": [], "f_3": [two]}, "model": "m"})
    put(b / "x.json", {"f_1": [one, two], "f_3": [two]})
    put(c / "x.json", [{"pose": {"file": "f_1", "i": 9}, "dets": [[one["box"], 0.5], [two["box"], 0.25]]}, {"pose": {"i": 7}, "dets": []}, {"pose": {"frame_idx": 3}, "dets": [[two["box"], 0.25]]}])
    want = [("f_1", 0, 0.0, 3.0, 0.5), ("f_1", 1, 4.0, 7.0, 0.25), ("f_3", 0, 4.0, 7.0, 0.25)]
    for d, third in ((a, "f_3"), (b, "f_3"), (c, "3")):
        got = sorted((r.key, r.n, r.x0, r.y1, r.conf) for r in frames.read_detections(spark, str(d), range_bytes=40).collect())
        assert got == sorted([*want[:2], (third, *want[2][1:])])


def test_coco_and_vgg(spark, tmp_path):
    coco = {"images": [{"id": 1, "file_name": "d/a.jpg"}], "annotations": [
        {"image_id": 1, "segmentation": [[0, 0, 2, 0, 2, 2]], "bbox": [0, 0, 9, 9]}, {"image_id": 1, "segmentation": [], "bbox": [1, 1, 3, 2]}, {"image_id": 1, "segmentation": {"counts": [1]}, "bbox": [0, 0, 1, 1]}]}
    got = frames.read_annotations(spark, put(tmp_path / "c.json", coco), "coco").collect()
    assert sorted((r.frame, len(r.ring)) for r in got) == [("a.jpg", 3), ("a.jpg", 4)]
    vgg = {"k": {"filename": "b.jpg", "regions": [{"shape_attributes": {"name": "polygon", "all_points_x": [0, 1, 1], "all_points_y": [0, 0, 1]}}, {"shape_attributes": {"name": "circle"}}]},
           "m": {"filename": "c.jpg", "regions": {"0": {"shape_attributes": {"name": "rect", "x": 1, "y": 2, "width": 3, "height": 4}}}}}
    got = frames.read_annotations(spark, put(tmp_path / "v.json", vgg), "vgg").collect()
    assert sorted((r.frame, len(r.ring)) for r in got) == [("b.jpg", 3), ("c.jpg", 4)]


def test_yolo_folder_keeps_empty_files(spark, tmp_path):
    put(tmp_path / "f1.txt", "0 0.5 0.5 0.2 0.2\nbroken line\n")
    put(tmp_path / "f2.txt", "")
    sizes = spark.createDataFrame([("f1", 100.0, 50.0), ("f2", 100.0, 50.0)], "stem string, w double, h double")
    boxes, files = frames.read_yolo(spark, str(tmp_path), sizes)
    b = boxes.collect()
    assert len(b) == 1 and (b[0].x0, b[0].y1) == (pytest.approx(40.0), pytest.approx(30.0))
    assert sorted(r.stem for r in files.collect()) == ["f1", "f2"]


def test_labels_poses_detections(spark, tmp_path):
    put(tmp_path / "area_1.ground_truth.json", {"7": True, "8": False})
    assert sorted((r.bay_id, r.gt) for r in frames.read_labels(spark, str(tmp_path), "area_1").collect()) == [("7", True), ("8", False)]
    assert frames.read_labels(spark, str(tmp_path), "none").count() == 0
    with pytest.raises(ValueError):
        frames.read_labels(spark, str(tmp_path), "../x")
    p = put(tmp_path / "poses.json", [{"i": 3, "x": 1, "y": 2, "alt": 30, "yaw": 0.1}, {"frame_idx": 4, "x": 1, "y": 2, "alt": 30}])
    got = frames.read_poses(spark, p)
    assert sorted(r.frame_idx for r in got.collect()) == [3, 4] and frames.usable_poses(got).count() == 1 and got.first().roll is None
    d = put(tmp_path / "dets.json", {"frames": {"frame_3": [{"box": [0, 1, 2, 3], "conf": 0.5}], "4": []}})
    dets = frames.read_detections(spark, d)
    poses = spark.createDataFrame([(3, "x/frame_3.jpg", None), (4, "frame_4.jpg", None)], "frame_idx int, file string, video_frame int")
    assert [(r.frame_idx, r.conf) for r in frames.detections_for(poses, dets).collect()] == [(3, 0.5)]


def test_airspace_file(spark, tmp_path):
    doc = {"features": [{"identifier": "A", "restriction": "PROHIBITED", "zoneAuthority": [{"name": "first"}], "geometry": [
        {"horizontalProjection": {"type": "Circle", "center": [23.0, 42.0], "radius": 1113.2}}, {"horizontalProjection": {"type": "Line"}}]}]}
    z = features.read_airspace(spark, put(tmp_path / "z.json", doc)).collect()
    assert len(z) == 1 and z[0].zone_id == "A#0" and z[0].authority == "first" and len(z[0].ring) == 49 and z[0].max_lat == pytest.approx(42.01)


def test_picture_statistics():
    px = np.full((60, 100, 3), 90, dtype=np.uint8)
    px[20:40, 30:70] = (200, 60, 60)
    assert (images.decode_ppm(images.encode_ppm(px)) == px).all()
    ring = np.array([(30, 20), (70, 20), (70, 40), (30, 40)], dtype=float)
    car, road = images.bay_stats(px, ring), images.bay_stats(px, ring + (0, 19.0))
    assert car["core_chroma"] == 140 and car["core_std"] > 50 and car["vis"] > 0.9
    assert road is None or road["core_chroma"] < 1
    assert images.bay_stats(px, ring + (90, 0)) is None


def test_pictures_are_opened_where_they_are_looked_at(spark, tmp_path):
    """Files give what bytes give, and nothing but names is shuffled."""
    rng = np.random.default_rng(5)
    shots = [(k, images.encode_ppm(rng.integers(0, 256, (60, 100, 3), dtype=np.uint8))) for k in range(300)]
    held = spark.createDataFrame(shots, "frame_idx int, content binary")
    images.write_pictures(held, str(tmp_path / "shots"))
    (tmp_path / "shots" / "notes.ppm").write_bytes(b"no number in its name")
    files = images.read_pictures(spark, str(tmp_path / "shots"), per_task=20)
    assert files.rdd.getNumPartitions() == 16 and sorted(r.frame_idx for r in files.collect()) == list(range(300))
    ring = F.array(*[geo.point(F.lit(x), F.lit(y)) for x, y in ((30.0, 20.0), (70.0, 20.0), (70.0, 40.0), (30.0, 40.0))])
    framed = spark.range(300).select(F.col("id").cast("int").alias("frame_idx"), F.array(F.struct(F.lit("a").alias("bay_id"), ring.alias("ring"))).alias("bays"))
    cam = geo.Camera(100, 60, 0.7854)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = images.core_features(files, framed.filter("frame_idx % 3 = 0"), cam)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got, want = found.collect(), images.core_features(held, framed.filter("frame_idx % 3 = 0"), cam).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 100 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert plan.count("Exchange") >= 2 and "content" not in plan
    assert sorted(map(tuple, images.image_stats(files).collect())) == sorted(map(tuple, images.image_stats(held).collect()))


def test_pictures_lie_in_packs(spark):
    """Packed pictures give what bytes give; there are as many files as tasks and sizes ask for, not as many as pictures."""
    rng = np.random.default_rng(6)
    shots = [(k, images.encode_ppm(rng.integers(0, 256, (60, 100, 3), dtype=np.uint8))) for k in range(300)]
    held = spark.createDataFrame(shots, "frame_idx int, content binary").repartition(4)
    packed = images.pack_pictures(held, per_task=50, pack_bytes=400_000)
    names = packed.collect()
    assert packed.rdd.getNumPartitions() == 6 and sorted(n.frame_idx for n in names) == list(range(300))
    assert 4 <= len({n.path.split("#")[0] for n in names}) <= 24
    assert sorted(map(tuple, images.image_stats(packed).collect())) == sorted(map(tuple, images.image_stats(held).collect()))


def test_counted_tones_have_the_same_quantiles():
    rng = np.random.default_rng(7)
    for _ in range(200):
        tones = rng.integers(0, rng.integers(1, 257), rng.integers(1, 400), dtype=np.uint8)
        counts = images._counts(tones)
        assert images._quantile(counts, 0.5) == np.median(tones) and abs(images._quantile(counts, 0.6) - np.percentile(tones, 60)) < 1e-9


def test_bays_of_a_frame_are_looked_at_together():
    """All outlines of a picture at once give what each gives alone, and a corner without a place takes none with it."""
    rng = np.random.default_rng(8)
    px = rng.integers(0, 256, (60, 100, 3), dtype=np.uint8)
    at = rng.uniform((-10, -10), (110, 70), (40, 2))
    half = rng.uniform(2, 15, (40, 2))
    rings = np.stack([at + half * s for s in ((-1, -1), (1, -1), (1, 1), (-1, 1))], axis=1)
    rings[5, 2, 0] = np.nan
    seen, found = images.bays_stats(px, rings)
    alone = [images.bay_stats(px, ring) for ring in rings]
    assert 0 < len(seen) < 39 and seen.tolist() == [i for i, st in enumerate(alone) if st]
    assert [dict(zip(images._FEATURES, row)) for row in found.tolist()] == [st for st in alone if st]


def test_a_pack_is_opened_once_for_all_its_pictures(spark, tmp_path):
    """Pictures of a batch are looked at pack by pack; detections and tones are those of the bytes."""
    rng = np.random.default_rng(9)
    shots = [(k, images.encode_ppm(rng.integers(0, 256, (60, 100, 3), dtype=np.uint8))) for k in range(200)]
    held = spark.createDataFrame(shots, "frame_idx int, content binary").repartition(4)
    packed = images.pack_pictures(held, per_task=100)
    packs, tasks = len({n.path.split("#")[0] for n in packed.collect()}), packed.rdd.getNumPartitions()
    log = str(tmp_path / "opened")

    def opener(path):
        with open(log, "a") as f:
            f.write(path + "\n")
        return documents.open_file(path)

    def model():
        return lambda px: [(45.0, 25.0, 55.0, 35.0, float(px.mean()))]

    def opened(df):
        open(log, "w").close()
        got = sorted(map(tuple, df.collect()))
        return got, len(open(log).read().splitlines())

    got, times = opened(images.image_stats(packed, opener=opener))
    assert got == sorted(map(tuple, images.image_stats(held).collect())) and packs <= times <= packs * tasks < 200
    cam = geo.Camera(w=100, h=60)
    poses = spark.range(200).select(F.col("id").cast("int").alias("frame_idx"), (F.col("id") * 7.0).alias("x"), F.lit(0.0).alias("y"), F.lit(30.0).alias("alt"), F.lit(0.3).alias("yaw"))
    bays = spark.range(300).select(F.col("id").cast("string").alias("bay_id"), (F.col("id") * 5.0).alias("x"), F.lit(1.0).alias("y"))
    bays = bays.withColumn("ring", geo.rectangle("x", "y", F.lit(1.0), F.lit(0.0), F.lit(4.0), F.lit(2.0)))
    scored = images.score_frames(packed, poses, bays, cam, model, opener=opener)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("__level") == 0  # views are there already
    got, times = opened(scored.select("frame_idx", "bay_id", "occupied", "off", F.coalesce("det_score", F.lit(-1.0))))
    want = images.score_frames(held, poses, bays, cam, model).select("frame_idx", "bay_id", "occupied", "off", F.coalesce("det_score", F.lit(-1.0)))
    assert len(got) > 200 and any(r[2] for r in got) and got == sorted(map(tuple, want.collect())) and packs <= times <= packs * tasks
