"""Frames and observations as streams: file source, keyed state, file sink.

Input is at-least-once and may arrive out of order.  What must be remembered lives in the engine's state store
(``processors.py``); outputs are append-only files written exactly once, so a restarted stream goes on where it stopped and a batch reads
nothing but its new files and the state of the keys in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import MISSION_IDLE_S
from ..operators import vote
from ..operators.scan import chunk_of_time, ordered_scan
from ..session import ship_code
from . import processors

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tail(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream, a few at a time when asked (rate-paced replay)."""
    r = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.load(path)


def start(out: DataFrame, path: str, once: bool = True, idle_batches: bool = True) -> StreamingQuery:
    """Append a stream to ``path``; its checkpoint lies beside the data.  ``once``: all that has arrived so far, then stop.

    Batches without new rows let watermarks close windows and fire timers.  State that expires by the clock asks for ever more of
    them, so a stream of that kind that shall stop needs ``idle_batches=False``.
    """
    spark = out.sparkSession
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle_batches).lower())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # keyed state with timers needs it
    ship_code(spark)
    w = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/_checkpoint")
    return (w.trigger(availableNow=True) if once else w).start(f"{path}/rows")


def written(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``start`` has appended so far."""
    return spark.read.schema(schema).parquet(f"{path}/rows")


def micros(ts: str):
    """A zone-less timestamp as microseconds since 1970."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', {ts})")


def bay_verdicts(observations: DataFrame, window_s: float = vote.BAY_WINDOW_S, as_of: str | None = None) -> DataFrame:
    """Observations to verdict changes (``processors.VERDICT``), as the batch vote would give them after every batch.

    The last row per bay is its state, the rows with ``flipped`` are what subscribers are told.  ``as_of`` fixes the time for a
    replay; without it the clock moves the window.
    """
    fixed = None if as_of is None else observations.sparkSession.range(1).select(micros(f"timestamp_ntz '{as_of}'")).first()[0]
    looks = observations.select("bay_id", micros("observed_at").alias("at"), F.col("event_id").alias("event"), F.col("frame_id").alias("frame"), F.col("mission_id").alias("mission"), "occupied", "backend")
    votes = processors.BayVotes(int(window_s * 1e6), fixed)
    return looks.groupBy("bay_id").transformWithState(votes, processors.VERDICT, "Append", "None" if fixed is not None else "ProcessingTime")


def current_states(verdicts: DataFrame) -> DataFrame:
    """State table from the verdict changes: the last one of every bay."""
    last = F.max_by(F.struct("occupied", "confidence", "backend"), F.col("seq")).alias("s")
    return verdicts.groupBy("bay_id").agg(last).select("bay_id", "s.*")


def frame_ledger(frames: DataFrame, keep_s: float | None = None) -> DataFrame:
    """Frames to a ledger with flight numbers (``processors.NUMBERED``): a re-sent frame adds nothing, a new one queues a job.

    Two keyed states in one stream: the first frame per ingest key, then the numbering per drone.  Within a batch the order is that of
    ``received_at``; over batches that of arrival.
    """
    keyed = frames.select("drone_id", vote.frame_key().alias("mission"), "frame_idx", "frame_id", micros("received_at").alias("at"))
    mode = "None" if keep_s is None else "ProcessingTime"
    first = keyed.groupBy("drone_id", "mission", "frame_idx").transformWithState(processors.FirstFrame(None if keep_s is None else int(keep_s * 1000)), processors.FIRST, "Append", mode)
    return first.groupBy("drone_id").transformWithState(processors.FlightNumbers(), processors.NUMBERED, "Append", mode)


def number_missions(frames: DataFrame, order: list | None = None, chunk_s: float = 86400.0) -> DataFrame:
    """Add ``flight_no`` per drone: a frame number below its predecessor's means the drone started over."""
    order = order or ["received_at", "frame_id"]
    prev = ordered_scan(frames, ["drone_id"], order, chunk_of_time(order[0], chunk_s), lag={"__last": "frame_idx"})
    again = (F.col("__last").isNotNull() & (F.col("frame_idx") < F.col("__last"))).cast("bigint")
    return ordered_scan(prev, ["drone_id"], order, chunk_of_time(order[0], chunk_s), running_sum={"flight_no": again}).drop("__last")


SERIES = "started timestamp, frames bigint"


def ingest_series(frames: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Frames per window, each row sent once: when no frame of it can come any more, ``delay`` behind the newest."""
    timed = frames.select(F.col("received_at").cast("timestamp").alias("received_at")).withWatermark("received_at", delay)
    w = timed.groupBy(F.window("received_at", width)).agg(F.count(F.lit(1)).alias("frames"))
    return w.select(F.col("window.start").alias("started"), "frames")


SESSIONS = "drone_id string, started timestamp, last_at timestamp, frames bigint"


def flight_sessions(frames: DataFrame, gap: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Activity sessions per drone, merged in state as frames arrive in any order, each sent once when it is over."""
    timed = frames.select("drone_id", F.col("received_at").cast("timestamp").alias("received_at")).withWatermark("received_at", delay)
    s = timed.groupBy("drone_id", F.session_window("received_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("frames"), F.max("received_at").alias("last_at"))
    return s.select("drone_id", F.col("w.start").alias("started"), "last_at", "frames")


def tone_changes(signs: DataFrame, who: str, seen: str, limit_s: float = MISSION_IDLE_S, delay: str = "10 minutes") -> DataFrame:
    """``(who, tone, at_ms)`` whenever a sender falls silent for ``limit_s`` or is heard again (``processors.TONES``)."""
    timed = signs.select(F.col(who).cast("string").alias("who"), F.col(seen).cast("timestamp").alias("seen")).withWatermark("seen", delay)
    timed = timed.filter("who is not null").withColumn("at_ms", F.unix_millis("seen"))
    return timed.groupBy("who").transformWithState(processors.Silence(int(limit_s * 1000)), processors.TONES, "Append", "EventTime")
