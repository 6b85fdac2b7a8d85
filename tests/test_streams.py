"""Streams stopped and started again after every delivery: nothing is lost, doubled or read twice."""

import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import vote
from kerbline.session import scratch_path
from kerbline.streaming import jobs, processors


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A stream keeps the number of state partitions that it started with; these are small."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


LOOKS = "event_id bigint, bay_id string, frame_id string, mission_id string, occupied boolean, backend string, observed_at timestamp_ntz"
AS_OF, WINDOW_S = "2024-05-01 12:00:00", 7200.0


def play(spark, parts, schema, build, out_schema, idle_batches=True):
    """Rows of every part in turn; the stream's rows and the input rows that each run read."""
    src, out, read = scratch_path(spark, "in"), scratch_path(spark, "out"), []
    for part in parts:
        spark.createDataFrame(part, schema).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("observed_at", "received_at") if c in schema}).write.mode("append").parquet(src)
        kind = spark.read.parquet(src).schema
        q = jobs.start(build(jobs.tail(spark, src, kind)), out, idle_batches=idle_batches)
        assert q.awaitTermination(120)
        read.append(sum(p["numInputRows"] for p in q.recentProgress))
    return jobs.written(spark, out, out_schema), read


def look(n, bay, minute, occupied, mission="m1", frame="", backend="h"):
    return (n, bay, frame if frame != "" else f"f{n}", mission, occupied, backend, f"2024-05-01 {10 + minute // 60:02d}:{minute % 60:02d}:30")


TEXT = LOOKS.replace("timestamp_ntz", "string")


def test_verdicts_follow_the_batch_vote(spark):
    """Late, repeated and shuffled looks: after the last part the states are those of the batch vote; every flip is told once."""
    rnd = random.Random(2)
    looks = [look(n, f"b{n % 3}", rnd.randint(-30, 110), rnd.random() < 0.5, rnd.choice(["m1", "m2", None]), None if n % 11 == 0 else f"f{n // 2}", rnd.choice(["h", "d", None])) for n in range(120) if n % 4 or n < 60]
    looks = [x for x in looks if int(x[6][11:13]) >= 10]
    parts = [looks[i::4] for i in range(4)]
    parts[3] += [x for x in parts[0] if x[2]]  # all of the first part once more
    rows, _ = play(spark, parts, TEXT, lambda s: jobs.bay_verdicts(s, WINDOW_S, AS_OF), processors.VERDICT)
    obs = spark.createDataFrame(looks, TEXT).withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
    once = vote.append_observations(obs.limit(0), obs, F.struct("observed_at", "event_id"))
    want = {r.bay_id: (r.occupied, r.confidence, r.backend) for r in vote.vote_states(once, AS_OF, WINDOW_S).collect()}
    assert {r.bay_id: (r.occupied, r.confidence, r.backend) for r in jobs.current_states(rows).collect()} == want
    log = rows.orderBy("bay_id", "seq").collect()
    for bay in want:
        mine = [r for r in log if r.bay_id == bay]
        assert [r.seq for r in mine] == list(range(1, len(mine) + 1))
        told = [r.occupied for r in mine if r.flipped]
        assert all(a != b for a, b in zip(told, told[1:])) and told[-1] == mine[-1].occupied


def test_a_batch_reads_no_history(spark):
    parts = [[look(100 * p + i, f"b{i}", 5 * p, bool((p + i) % 2)) for i in range(10)] for p in range(6)]
    rows, read = play(spark, parts, TEXT, lambda s: jobs.bay_verdicts(s, WINDOW_S, AS_OF), processors.VERDICT)
    assert read == [10] * 6
    assert rows.groupBy("bay_id").count().count() == 10


def test_looks_outside_the_window_and_empty_parts(spark):
    early = [(1, "b", "f1", "m", True, "h", "2024-05-01 09:59:00"), (2, "b", "f2", "m", True, "h", None)]
    rows, _ = play(spark, [early, [], [look(3, "b", 0, False)]], TEXT, lambda s: jobs.bay_verdicts(s, WINDOW_S, AS_OF), processors.VERDICT)
    assert [(r.seq, r.occupied, r.confidence, r.flipped) for r in rows.collect()] == [(1, False, 1.0, True)]


FRAMES = "frame_id string, drone_id string, mission_id string, survey_area string, frame_idx int, received_at string"


def frame(n, drone, idx, at, mission="m"):
    return (f"g{n}", drone, mission, "a", idx, f"2024-05-01 {at}")


def test_ledger_numbers_flights_over_restarts(spark):
    parts = [[frame(1, "d", 1, "10:00:00"), frame(2, "d", 2, "10:00:10"), frame(3, "e", 9, "10:00:11")],
             [frame(12, "d", 2, "10:01:00"), frame(4, "d", 3, "10:01:10")],  # index 2 is sent again and adds nothing
             [frame(5, "d", 0, "10:02:00", "m2"), frame(6, "d", 1, "10:02:10", "m2"), frame(7, "e", 4, "10:02:11")]]
    rows, _ = play(spark, parts, FRAMES, jobs.frame_ledger, processors.NUMBERED)
    got = {r.frame_id: r.flight_no for r in rows.collect()}
    assert got == {"g1": 0, "g2": 0, "g3": 0, "g4": 0, "g5": 1, "g6": 1, "g7": 1}
    assert rows.filter("status = 'queued'").count() == 7


def test_a_drone_that_stops(spark):
    """Silence makes a row without any frame of that drone; a late frame fills the gap it lies in."""
    parts = [[frame(1, "d", 1, "10:00:00"), frame(2, "e", 1, "10:00:05")],
             [frame(3, "e", 2, "10:04:00"), frame(4, "e", 3, "10:10:00")],
             [frame(5, "e", 4, "10:07:30"), frame(6, "e", 5, "10:13:00"), frame(7, "d", 2, "10:30:00"), frame(8, "e", 6, "10:16:00")],
             [frame(9, "beat", 1, "23:00:00")]]
    rows, _ = play(spark, parts, FRAMES, lambda s: jobs.tone_changes(s, "drone_id", "received_at", 300, "5 minutes"), processors.TONES)
    got = rows.filter("who <> 'beat'").withColumn("at", F.date_format(F.timestamp_millis("at_ms"), "HH:mm:ss")).orderBy("who", "at_ms").collect()
    assert [(r.who, r.tone, r.at) for r in got] == [
        ("d", "good", "10:00:00"), ("d", "warn", "10:05:00"), ("d", "good", "10:30:00"), ("d", "warn", "10:35:00"),
        ("e", "good", "10:00:05"), ("e", "warn", "10:21:00")]


def test_series_and_sessions_with_late_rows(spark):
    parts = [[frame(1, "d", 1, "10:00:10"), frame(2, "d", 2, "10:03:00")],
             [frame(3, "d", 3, "10:00:50"), frame(4, "d", 4, "10:20:00")],  # late, but inside the delay
             [frame(5, "d", 5, "10:01:00"), frame(6, "d", 6, "10:21:00")],  # too late: its window has gone out
             [frame(7, "beat", 1, "23:00:00")]]
    rows, _ = play(spark, parts, FRAMES, lambda s: jobs.ingest_series(s, "1 minute", "10 minutes"), jobs.SERIES)
    got = {r.t: r.frames for r in rows.select(F.date_format("started", "HH:mm").alias("t"), "frames").collect()}
    assert got == {"10:00": 2, "10:03": 1, "10:20": 1, "10:21": 1}
    rows, _ = play(spark, parts, FRAMES, lambda s: jobs.flight_sessions(s, "5 minutes", "10 minutes"), jobs.SESSIONS)
    got = rows.filter("drone_id <> 'beat'").select(F.date_format("started", "HH:mm:ss").alias("a"), F.date_format("last_at", "HH:mm:ss").alias("b"), "frames").orderBy("a").collect()
    assert [tuple(r) for r in got] == [("10:00:10", "10:03:00", 3), ("10:20:00", "10:21:00", 2)]


def test_paced_replay(spark):
    src, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    spark.range(40).repartition(4).write.parquet(src)
    q = jobs.start(jobs.tail(spark, src, "id bigint", files_per_batch=1), out)
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 4
    assert jobs.written(spark, out, "id bigint").count() == 40


def test_marks_that_expire_by_the_clock(spark):
    parts = [[frame(1, "d", 1, "10:00:00")], [frame(2, "d", 1, "10:00:30"), frame(3, "d", 2, "10:00:40")]]
    rows, _ = play(spark, parts, FRAMES, lambda s: jobs.frame_ledger(s, 3600.0), processors.NUMBERED, idle_batches=False)
    assert sorted(r.frame_id for r in rows.collect()) == ["g1", "g3"]


class Held:
    """State of one key in memory."""

    def __init__(self):
        self.rows, self.most = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows

    def put(self, rows):
        self.rows, self.most = rows, max(self.most, len(rows))

    update = put

    def clear(self):
        self.rows = []


def test_waiting_signs_are_two_a_stretch():
    """However many signs wait, two per stretch are held; tones are those of all signs."""
    rnd = random.Random(5)
    limit = 600
    signs = [rnd.randrange(k, k + 2000) for k in (0, 2100, 9000, 9601, 30000, 33600) for _ in range(3000)]
    pending, last, watermark = Held(), Held(), [-1]
    tones = processors.Silence(limit)
    tones.init(type("Handle", (), {"getListState": lambda *a: pending, "getValueState": lambda *a: last, "listTimers": lambda self: [], "deleteTimer": lambda *a: None, "registerTimer": lambda *a: None})())
    timers = type("Timers", (), {"getCurrentWatermarkInMs": lambda self: watermark[0]})()
    got = []
    for i in range(4):
        got += tones.handleInputRows(("d",), iter([{"at_ms": at} for at in signs[i::4]]), timers)
    assert not got and pending.most <= 2 * (36000 // limit)
    for watermark[0] in (1234, 9100, 9700, 31000, 100000):
        got += tones.handleExpiredTimer(("d",), timers, None)
    all_signs = sorted(set(signs))
    want = [("good", b) for a, b in zip([None, *all_signs], all_signs) if a is None or b - a >= limit]
    want += [("warn", a + limit) for a, b in zip(all_signs, [*all_signs[1:], None]) if b is None or b - a >= limit]
    assert sorted((r.tone, r.at_ms) for r in got) == sorted(want) and len(want) > 4
