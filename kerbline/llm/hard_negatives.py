"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

Candidates are dealt into blocks of bounded bytes.  In a block every dimension is a list sorted by value; an anchor reads a list from
the large end where its component is positive and from the small end where it is negative, so what it has not met after
``t`` entries of every list scores at most the sum of its components times the last values read.  Rows met are scored exactly, in
integers (random access), and an anchor stops in a block once that sum is strictly below what could still enter each of its
windows.  Anchors that go through a block together share one sorted access from both ends; thresholds and stops are each anchor's own.
The best of the blocks are then ranked over all.

A window is a range of scores; the first pass has one window without limits per anchor (rows of its label), the second one per positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut, ship_code
from .lattice import exact_type, integers, matrix, whole

# Components in a block of candidates, anchors of a slice that meets a block in one task, anchors scored together.
BLOCK, SLICE, TOGETHER = 1 << 20, 4096, 256
FAR = 2**62


class Lists:
    """The sorted lists of some candidates: rows in the order in which sorted access from both ends meets them, and the values read."""

    def __init__(self, x: np.ndarray):
        n, _ = x.shape
        order = np.argsort(x, axis=0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
        first = np.minimum(rank, n - 1 - rank).min(axis=1, initial=n - 1)
        self.rows = np.argsort(first, kind="stable")
        depths = [1]
        while depths[-1] < n:
            depths.append(min(n, depths[-1] + max(1, depths[-1] // 2)))
        values = np.take_along_axis(x, order, axis=0)
        #: Rows met after each depth, and the last values read from the small and the large ends.
        self.met = np.searchsorted(first[self.rows], depths)
        self.small, self.large = values[np.array(depths) - 1], values[n - np.array(depths)]
        self.x, self.most = x[self.rows], int(np.abs(x).max(initial=0))


def keep_best(key: np.ndarray, score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` first of every key: higher scores, then lower ``at``."""
    order = np.lexsort((at, -score, key))
    first = np.r_[True, key[order][1:] != key[order][:-1]] if len(order) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else first
    return order[np.arange(len(order)) - start < k]


def scan(lists: Lists, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, allowed) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The best ``k`` rows of every anchor's windows ``low..high`` (arrays of anchors by windows; empty where low > high).

    ``allowed(a, row)`` says which pairs count.  Returns anchor * windows + window, row and score of each, and the scores computed.
    """
    many, width = low.shape
    key, row, score = (np.empty(0, np.int64) for _ in range(3))
    floor = np.where(low > high, FAR, low)  # what can still enter a window scores as much at least
    kind = exact_type(anchors.shape[1], lists.most, int(np.abs(anchors).max(initial=0)))
    x, a = lists.x.astype(kind), anchors.astype(kind)
    positive, negative = np.maximum(anchors, 0), np.minimum(anchors, 0)
    going, done, scored = np.flatnonzero((floor < FAR).any(axis=1)), 0, 0
    for step, met in enumerate(lists.met):
        if not len(going):
            break
        s = a[going] @ x[done:met].T
        scored += s.size
        hit_a, hit_r = np.nonzero((s >= floor[going].min(axis=1)[:, None].astype(s.dtype)) & (s <= high[going].max(axis=1)[:, None].astype(s.dtype)))
        if len(hit_a):
            value, hit_a, hit_r = s[hit_a, hit_r].astype(np.int64), going[hit_a], lists.rows[done + hit_r]
            good = allowed(hit_a, hit_r)
            value, hit_a, hit_r = value[good], hit_a[good], hit_r[good]
            at, w = np.nonzero((value[:, None] >= floor[hit_a]) & (value[:, None] <= high[hit_a]))
            key, row, score = np.r_[key, hit_a[at] * width + w], np.r_[row, hit_r[at]], np.r_[score, value[at]]
            best = keep_best(key, score, row, k)
            key, row, score = key[best], row[best], score[best]
            full, count = np.unique(key, return_counts=True)
            last = np.cumsum(count) - 1
            full, last = full[count == k], last[count == k]
            floor.reshape(-1)[full] = np.maximum(floor.reshape(-1)[full], score[last])
        done = met
        # sums of integers: exact, so "strictly below" is what it says
        threshold = (positive[going] * lists.large[step] + negative[going] * lists.small[step]).sum(axis=1)
        going = going[threshold >= floor[going].min(axis=1)]
    return key, row, score, scored


def same_label(t: pa.Table, a: pa.Table, k: int, cache: dict) -> Iterator[tuple]:
    """First pass: anchors meet the lists of their own label alone."""
    labels, of = t.column("label").to_numpy(), a.column("label").to_numpy()
    for label in np.unique(of):
        rows = np.flatnonzero(labels == label)
        if not len(rows):
            continue
        if label not in cache:
            cache.clear()  # anchors come in the order of labels
            cache[label] = Lists(matrix(t.column("vec").take(pa.array(rows)).combine_chunks(), t.column("dim")[0].as_py()))
        mine = np.flatnonzero(of == label)
        x = matrix(a.column("vec").take(pa.array(mine)).combine_chunks(), t.column("dim")[0].as_py())
        low = np.full((len(mine), 1), -FAR)
        key, row, score, _ = scan(cache[label], x, low, -low, k, lambda i, r, rows=rows, mine=mine: others(t, a, rows[r], mine[i]))
        yield mine[key], np.zeros(len(key), np.int32), rows[row], score


def in_windows(t: pa.Table, a: pa.Table, k: int, cache: dict) -> Iterator[tuple]:
    """Second pass: anchors meet all lists, rows of other labels count."""
    dim = t.column("dim")[0].as_py()
    if "all" not in cache:
        cache["all"] = Lists(matrix(t.column("vec").combine_chunks(), dim))
    labels, of = t.column("label").to_numpy(), a.column("label").to_numpy()
    highs = a.column("high").to_pylist()
    low, high = np.full((len(highs), max(map(len, highs))), FAR), np.full((len(highs), max(map(len, highs))), -FAR)
    for i, h in enumerate(highs):  # 80 * positive <= 100 * negative <= 100 * positive
        high[i, :len(h)] = h
        low[i, :len(h)] = [-(-4 * p // 5) for p in h]
    key, row, score, _ = scan(cache["all"], matrix(a.column("vec").combine_chunks(), dim), low, high, k, lambda i, r: (labels[r] != of[i]) & others(t, a, r, i))
    yield key // low.shape[1], (key % low.shape[1]).astype(np.int32), row, score


def others(t: pa.Table, a: pa.Table, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Pairs whose ids differ."""
    return pc.not_equal(t.column("id").take(pa.array(row)), a.column("id").take(pa.array(anchor))).to_numpy()


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """``(candidates, anchors)`` of one block, some anchors at a time, from rows in the order of dim, block, slice, side."""
    held: list[pa.Table] = []
    unit = None
    block = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        keys = np.stack([t.column(c).to_numpy() for c in ("dim", "block", "slice", "side")], axis=1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        for at, end in zip(starts, np.r_[starts[1:], len(keys)]):
            now, side, part = tuple(keys[at, :3]), keys[at, 3], t.slice(at, end - at)
            if now != unit:
                unit, held, block = now, [], None
            if side == 0:
                held.append(part)
                continue
            if block is None:
                block = pa.concat_tables(held).combine_chunks() if held else part.slice(0, 0)
                held = []
            for i in range(0, part.num_rows, TOGETHER) if block.num_rows else ():
                yield block, part.slice(i, TOGETHER).combine_chunks()


def meet(rows: DataFrame, anchors: DataFrame, k: int, step, shape: tuple[int, int]) -> DataFrame:
    """``(aid, atag, w, id, tag, score)``: the best ``k`` of every anchor's windows among all rows."""
    blocks, slices = shape
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cache = None, {}
        for t, a in units(batches):
            if t is not last:
                last, cache = t, {}
            for anchor, w, row, score in step(t, a, k, cache):
                i, r = pa.array(anchor), pa.array(row)
                cells = [a.column("id").take(i), a.column("tag").take(i), pa.array(w, pa.int32()), t.column("id").take(r), t.column("tag").take(r), pa.array(score, pa.int64())]
                yield from pa.table(cells, ["aid", "atag", "w", "id", "tag", "score"]).combine_chunks().to_batches()

    def number(of, parts):
        return F.pmod(F.xxhash64("id", "tag", F.lit(of)), F.lit(parts)).cast("int")

    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    both = (rows.withColumns({"side": F.lit(0), "high": F.lit(None).cast("array<bigint>"), "block": number("block", blocks)}).withColumn("slice", every(slices))
            .unionByName(anchors.withColumns({"side": F.lit(1), "slice": number("slice", slices)}).withColumn("block", every(blocks))))
    # candidates by id, so that their places break ties; anchors by label
    turn = F.when(F.col("side") == 1, F.col("label"))
    dealt = both.repartition(2 * blocks * slices, "dim", "block", "slice").sortWithinPartitions("dim", "block", "slice", "side", turn, "id", "tag")
    found = dealt.mapInArrow(run, f"aid {kind}, atag bigint, w int, id {kind}, tag bigint, score bigint")
    order = Window.partitionBy("aid", "atag", "w").orderBy(F.col("score").desc(), "id", "tag")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, k: int = 5, positives: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Scores are inner products of ``floor(scale * x)``.  Per anchor and each of its first ``positives`` other rows of its label: the first ``k`` rows of
    other labels that score 0.8 to 1 times the positive's score; higher scores first, ties by smaller key.  ``label`` may be an expression;
    labels are integers.

    Rows with a null key, label or vector or with a null or non-finite component take no part; rows are compared with those of as many
    components; a row given twice is one row; different rows under one key are rows of their own, but never each other's partners.
    A positive that scores below 0 has an empty window.  An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    kind = dict(vectors.dtypes)[key]
    named = vectors.select(F.col(key).alias("id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"), F.col(vector).alias("vec"), is_anchor.alias("anchor"))
    named = named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & whole(F.col("vec")) & (F.size("vec") > 0))
    rows = cut(integers(named, "vec", scale).withColumn("tag", F.xxhash64("label", "vec")).dropDuplicates(["id", "tag"]))
    size = rows.agg(F.coalesce(F.sum("dim"), F.lit(0)).alias("parts"), F.count_if("anchor").alias("anchors")).first()
    blocks = max(1, -(-size.parts // BLOCK))
    # enough units to keep the cluster busy, unless slices would become tiny
    slices = max(-(-size.anchors // SLICE), min(-(-size.anchors // 64), -(-2 * spark.sparkContext.defaultParallelism // blocks)), 1)
    asked = rows.filter("anchor").drop("anchor")
    rows = rows.drop("anchor")
    found = meet(rows, asked.withColumn("high", F.lit(None).cast("array<bigint>")), positives, same_label, (blocks, slices))
    positive = cut(found.filter("score >= 0").select("aid", "atag", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # an anchor's windows lie in the order of its positives, and those below 0 come last
    windows = positive.groupBy("aid", "atag").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "positive_score"))), lambda p: p["positive_score"]).alias("high"))
    asked = asked.join(windows, (F.col("id") == F.col("aid")) & (F.col("tag") == F.col("atag"))).drop("aid", "atag")
    negative = meet(rows, asked.select(*rows.columns, "high"), k, in_windows, (blocks, slices)).withColumn("w", F.col("w") + 1)
    out = negative.join(positive, ["aid", "atag", "w"])
    return out.select(F.col("aid").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").cast(kind).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
