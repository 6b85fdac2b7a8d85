"""Label sets: sampling, splits, merging and frame selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from ..session import cut, scratch_path
from .components import link_points
from .scan import chunk_of, global_number, latest_per_key, ordered_scan
from .spatial import near_pairs


def skip_done(files: DataFrame, *done: DataFrame, key: str = "stem") -> DataFrame:
    """Files nobody handled yet."""
    for d in done:
        files = files.join(d.select(key).distinct(), key, "left_anti")
    return files


def every_nth(df: DataFrame, order: list, n: int) -> DataFrame:
    """Every ``n``-th row in ``order``, the first included."""
    num = global_number(df, order, "__n")
    return num.filter(F.pmod(F.col("__n") - 1, F.lit(n)) == 0).drop("__n")


def split_by_range(df: DataFrame, no: str, val: Column, exclude: list[tuple[int, int]] | None = None) -> DataFrame:
    """Drop excluded number ranges and mark the rest ``val`` or ``train``."""
    for lo, hi in exclude or []:
        df = df.filter(~F.col(no).between(lo, hi))
    return df.withColumn("split", F.when(val, "val").otherwise("train"))


FOOTPRINT_M = 25.0


def suggest_splits(poses: DataFrame, no: str, step: int, min_train: int = 5, min_val: int = 3, ok_m: float = FOOTPRINT_M) -> DataFrame:
    """``(cut, train, val, min_m, ok)`` for cuts every ``step`` frame numbers: least distance across each cut.

    Two neighbouring frames straddle every cut, so no cut's least distance exceeds the longest step
    between neighbours; only pairs that close are formed.  A pair constrains the cuts between its numbers,
    and of the frames taken at one spot only the first and the last number matter.
    """
    p = poses.select(F.col(no).alias("n"), "x", "y").withColumn("__one", F.lit(0))
    walk = ordered_scan(p, ["__one"], ["n"], chunk_of("n", 4096), lag={"px": "x", "py": "y"})
    longest = walk.agg(F.max(geo.distance("px", "py", "x", "y"))).first()[0] or 0.0
    spots = p.groupBy("x", "y").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = spots.select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("hi").alias("qhi"))
    reach = max(float(longest), 1e-6)
    pair = near_pairs(spots, other, "x", "y", ("qx", "qy", "qx", "qy"), reach, reach).withColumn("d", geo.distance("x", "y", "qx", "qy"))
    first, last = F.floor(F.col("lo") / step) + 1, F.floor(F.col("qhi") / step)
    span = pair.filter((F.col("lo") < F.col("qhi")) & (first <= last)).groupBy(first.alias("a"), last.alias("b")).agg(F.min("d").alias("d"))
    near = span.select(F.explode(F.sequence("a", "b")).alias("k"), "d").groupBy("k").agg(F.min("d").alias("min_m"))
    # frames per block of `step` numbers, summed over the (few) blocks
    blocks = p.groupBy("__one", (F.floor(F.col("n") / step) + 1).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    sums = ordered_scan(blocks, ["__one"], ["k"], chunk_of("k", 1024), running_sum={"train": F.col("c")}, total={"total": F.col("c")})
    out = sums.withColumn("val", F.col("total") - F.col("train")).filter((F.col("train") >= min_train) & (F.col("val") >= min_val)).join(near, "k")
    return out.select((F.col("k") * step).alias("cut"), "train", "val", "min_m", (F.col("min_m") >= ok_m).alias("ok"))


def merge_datasets(sources: DataFrame, benchmark: list[str], benchmark_only_val: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(merged, collisions)`` of ``source, source_rank, split, stem, boxes``: the first source of a stem wins.

    Hand-drawn benchmark sources are marked and, on request, go to ``val`` whole.
    """
    order = F.struct("source_rank", F.when(F.col("split") == "train", 0).otherwise(1))
    hand = F.col("source").isin(*benchmark)
    won = latest_per_key(sources, ["stem"], order, newest=False)
    split = F.when(hand & F.lit(benchmark_only_val), "val").otherwise(F.col("split"))
    merged = won.select("stem", "source", F.col("split").alias("source_split"), split.alias("split"), "boxes", hand.alias("hand_drawn"))
    return merged, sources.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("stem", (F.col("n") - 1).alias("dropped"))


def merge_drawings(rings: DataFrame, r: float = 2.0) -> DataFrame:
    """Repeated outlines of one bay averaged vertex by vertex: ``(label, drawings, ring)``.

    Outlines belong together when their centres link up within ``r``; each is turned to start at the
    vertex nearest the first outline's start before averaging.
    """
    c = rings.withColumn("ring", geo.open_ring(F.col("ring"))).withColumn("__c", geo.vertex_centroid(F.col("ring")))
    linked = cut(link_points(c.withColumns({"x": F.col("__c.x"), "y": F.col("__c.y")}).drop("__c"), r))
    base = linked.groupBy("label").agg(F.min_by("ring", "drawing_id").alias("base"), F.min(F.size("ring")).alias("n"), F.count(F.lit(1)).alias("drawings"))
    j = linked.join(base, "label").withColumns({"ring": F.slice("ring", F.lit(1), F.col("n")), "base": F.slice("base", F.lit(1), F.col("n"))})

    def miss(i):
        return F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda s, k: s + geo.distance(
            F.get("ring", (i + k) % F.col("n")).x, F.get("ring", (i + k) % F.col("n")).y, F.get("base", k).x, F.get("base", k).y))

    shift = F.array_min(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.round(miss(i), 9).alias("m"), i.alias("i")))).i
    v = j.withColumn("__s", shift).select("label", "drawings", "n", "__s", F.posexplode("ring").alias("k", "p"))
    v = v.withColumn("k", F.pmod(F.col("k") - F.col("__s"), F.col("n")))
    mean = v.groupBy("label", "drawings", "k").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"))
    ring = F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda e: geo.point(e.x, e.y))
    return mean.groupBy("label", "drawings").agg(ring.alias("ring"))


# Frames whose gain is within this share of the best one are as good as the best.
COVER_SLACK = 0.25


def cover_frames(views: DataFrame, slack: float | None = None) -> DataFrame:
    """``(step, frame_idx, gained)``: frames that together show every bay.

    ``slack=None`` is the greedy choice, always the frame that adds most, ties to the least frame: a round takes every frame that comes
    before all others showing one of its uncovered bays, as none of those can change what it adds.  Where frames that add
    alike overlap in long rows that is one frame a round.

    With ``slack`` a frame may also be taken that adds at least ``1/(1+slack)`` of what the best one adds, so at most ``1+slack`` times as
    many frames as the greedy bound allows are taken.  Such frames get a random rank, new in each round, and those that come first among all that show one of
    their uncovered bays are taken: few rounds per class of gains, as of a random maximal independent set, and
    ``log(largest gain) / log(1+slack)`` classes, so rounds grow with logarithms alone.
    """
    spark = views.sparkSession
    todo = cut(views.select("frame_idx", "bay_id").filter("frame_idx is not null and bay_id is not null").distinct())
    kind = dict(todo.dtypes)["frame_idx"]
    path, turn = scratch_path(spark, "cover"), 0
    while not todo.isEmpty():
        gain = todo.groupBy("frame_idx").agg(F.count(F.lit(1)).alias("gained"))
        if slack is None:
            rank = (-F.col("gained")).alias("less")
        else:
            gain = cut(gain)
            best = gain.agg(F.max("gained")).first()[0]
            gain = gain.filter(F.col("gained") * (1 + slack) >= best)
            rank = F.xxhash64("frame_idx", F.lit(turn)).alias("less")
        first = F.min(F.struct(rank, "frame_idx", "gained")).alias("first")
        won = cut(todo.join(gain, "frame_idx").groupBy("bay_id").agg(first).select("bay_id", "first.frame_idx", "first.gained"))
        new = cut(won.groupBy("frame_idx", "gained").agg(F.count(F.lit(1)).alias("n")).filter("n = gained").select("frame_idx", "gained", F.lit(turn).alias("turn")))
        new.write.mode("append").parquet(path)
        shown = won.join(new.select("frame_idx"), "frame_idx", "left_semi").select("bay_id")
        todo = cut(todo.join(shown, "bay_id", "left_anti"))
        turn += 1
    picked = spark.read.schema(f"frame_idx {kind}, gained bigint, turn int").parquet(path) if turn else spark.createDataFrame([], f"frame_idx {kind}, gained bigint, turn int")
    order = [F.col("gained").desc(), "frame_idx"]
    return global_number(picked, order if slack is None else ["turn", *order], "step").select(F.col("step").cast("int").alias("step"), "frame_idx", "gained")


def unreachable(bays: DataFrame, views: DataFrame) -> DataFrame:
    """``(bay_id,)`` of the bays that no frame shows: what no cover can reach."""
    return bays.select("bay_id").join(views.select("bay_id").distinct(), "bay_id", "left_anti")
