"""Closest items by a descent through nested cells.

Items are put into a tree of cells, four per axis in each; a cell knows the box of its items and the box of one of them.
A point opens, level by level, only cells that may hold something as close as what another cell surely holds.  The depth
follows the data (few items per last cell), so no point is given up and far or piled items do not meet all points.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import let
from ..session import cut, spread

# Items that a last cell may hold, and the levels at which cells are as small as doubles tell apart.
LEAF_ITEMS, DEEPEST = 16, 20
# Levels whose cells are few by construction (at most 16 + 256 + 4096 on a plane) and sent to every task.
SHALLOW = 3


def _far(p: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.abs(p - lo), F.abs(hi - p))


def _gap(p: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo - p, p - hi, F.lit(0.0))


def _norm(parts: list[Column]) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def _tree(items: DataFrame, dims: int, keys: list[str]) -> tuple[DataFrame, DataFrame, int, float] | None:
    """``(tree, leaves, depth, span)``: children of every cell by level, items with their last cell."""
    lo, hi = [f"lo{d}" for d in range(dims)], [f"hi{d}" for d in range(dims)]
    ends = items.agg(*[F.min(c).alias(c) for c in lo], *[F.max(c).alias(c) for c in hi], F.count(F.lit(1)).alias("n")).first()
    if not ends.n:
        return None
    span = max(ends[h] - ends[c] for c, h in zip(lo, hi))
    side = span / 4 if span > 0 else 1.0
    depth = max(0, math.ceil(math.log(max(1.0, ends.n / LEAF_ITEMS), 4) / dims))
    while True:
        most = 4 ** (depth + 1) - 1
        cells = [F.greatest(F.lit(0), F.least(F.lit(most), F.floor(((F.col(c) + F.col(h)) / 2 - F.lit(ends[c])) * F.lit(4.0**depth / side)))).cast("bigint").alias(f"c{d}") for d, (c, h) in enumerate(zip(lo, hi))]
        leaves = items.select("*", *cells)
        at = [f"c{d}" for d in range(dims)]
        if span == 0 or depth >= DEEPEST or (leaves.groupBy(*keys, *at).count().agg(F.max("count")).first()[0] or 0) <= LEAF_ITEMS:
            break
        depth += 1
    whole = [F.min(c).alias(c) for c in lo] + [F.max(c).alias(c) for c in hi]
    one = F.min(F.struct(*lo, *hi)).alias("one")
    last = leaves.groupBy(*keys, *at).agg(*whole, one, F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    up = last.select("*", levels).select(*keys, "level", *[F.expr(f"shiftright(c{d}, 2 * ({depth} - level))").alias(f"c{d}") for d in range(dims)], *lo, *hi, "one", "n")
    nodes = up.groupBy(*keys, "level", *at).agg(*whole, F.min("one").alias("one"), F.sum("n").alias("n"))
    kids = nodes.groupBy(*keys, "level", *[F.shiftright(c, 2).alias(f"up_{c}") for c in at]).agg(F.collect_list(F.struct(*at, *lo, *hi, "one", "n")).alias("kids"))
    return cut(kids), leaves, depth, span


def closest(points: DataFrame, items: DataFrame, dims: int, exact: Callable[[], Column], order: str, k: int = 1, limit: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """``points`` joined with their ``k`` closest ``items`` as ``(point, dist, <item columns>)``, ties to the least ``order``.

    ``points``: ``point, p0.., <keys>``; ``items``: ``lo0.., hi0.., <keys>`` and what ``exact()`` needs, which must not be less
    than the distance to the box nor more than to its farthest corner.  Only items with equal ``keys`` are looked at.  Rows with
    a coordinate that is null or not finite take no part; points without any item (within ``limit``) are absent.
    """
    keys = keys or []
    fine = [F.col(f"p{d}").isNotNull() & ~F.isnan(f"p{d}") & (F.abs(f"p{d}") < math.inf) for d in range(dims)]
    sound = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf) for d in range(dims) for c in (f"lo{d}", f"hi{d}")]
    for f in fine:
        points = points.filter(f)
    for f in sound:
        items = items.filter(f)
    payload = [c for c in items.columns if c not in keys]
    # every depth that is tried, the tree and the end read the items
    items = cut(items)
    built = _tree(items, dims, keys)
    if built is None:
        return points.filter("false").select("point", F.lit(0.0).alias("dist"), *[F.lit(None).cast(items.schema[c].dataType).alias(c) for c in payload])
    tree, leaves, depth, span = built
    at = [f"c{d}" for d in range(dims)]
    mine = [c for c in points.columns]
    # what is known to hold k items goes along, so that a cell opened later sends on nothing beyond it
    state = spread(points, "point").select(*mine, *[F.lit(0).cast("bigint").alias(c) for c in at], F.lit(math.inf if limit is None else float(limit)).alias("bound"))
    per = Window.partitionBy("point")

    def within(low: Column, bound: Column) -> Column:
        return low <= bound + (bound + span) * 1e-12

    def least_for_k(kids: Column) -> Column:
        """The distance inside which the nearest cells of a row surely hold k items."""
        if k == 1:
            return F.array_min(F.transform(kids, lambda x: x["high"]))
        start = F.struct(F.lit(k).cast("bigint").alias("left"), F.lit(math.inf).alias("high"))
        by_high = F.array_sort(F.transform(kids, lambda x: F.struct(x["high"].alias("high"), x["n"].alias("n"))))
        return F.aggregate(by_high, start, lambda a, x: F.when(a["left"] <= 0, a).otherwise(F.struct(
            (a["left"] - x["n"]).alias("left"), F.when(a["left"] <= x["n"], x["high"]).otherwise(F.lit(math.inf)).alias("high"))), lambda a: a["high"])

    for level in range(depth + 1):
        kids = tree.filter(F.col("level") == level).drop("level")
        kids = kids.select(*[F.col(c).alias(f"k_{c}") for c in keys], *[F.col(f"up_{c}").alias(f"k_{c}") for c in at], "kids")
        if level < SHALLOW and not keys and dims == 2:
            kids = F.broadcast(kids)
        p = [F.col(f"p{d}") for d in range(dims)]
        opened = state.join(kids, [F.col(c) == F.col(f"k_{c}") for c in [*keys, *at]]).select(*mine, "bound", F.transform("kids", lambda x: F.struct(
            *[x[c].alias(c) for c in at], x["n"].alias("n"),
            _norm([_gap(p[d], x[f"lo{d}"], x[f"hi{d}"]) for d in range(dims)]).alias("low"),
            F.least(_norm([_far(p[d], x[f"lo{d}"], x[f"hi{d}"]) for d in range(dims)]),
                    _norm([_far(p[d], x["one"][f"lo{d}"], x["one"][f"hi{d}"]) for d in range(dims)]) if k == 1 else F.lit(math.inf)).alias("high"))).alias("kids"))
        # what a sibling rules out need not leave the row; distances and the least of them are computed once a row
        kept = let(F.col("kids"), lambda v: let(F.least(F.col("bound"), least_for_k(v)), lambda least: F.filter(v, lambda x: within(x["low"], least))))
        flat = opened.select(*mine, "bound", F.explode(kept).alias("kid")).select(*mine, "bound", "kid.*")
        if k == 1:
            bound = F.min("high").over(per)
        else:
            upto = per.orderBy("high").rangeBetween(Window.unboundedPreceding, Window.currentRow)
            flat = flat.withColumn("enough", F.when(F.sum("n").over(upto) >= k, F.col("high")))
            bound = F.min("enough").over(per)
        state = flat.withColumn("bound", F.least("bound", bound)).filter(within(F.col("low"), F.col("bound"))).select(*mine, *at, "bound")
    found = state.join(leaves.select(*[F.col(c).alias(f"k_{c}") for c in [*keys, *at]], *payload), [F.col(c) == F.col(f"k_{c}") for c in [*keys, *at]])
    found = found.filter(within(_norm([_gap(F.col(f"p{d}"), F.col(f"lo{d}"), F.col(f"hi{d}")) for d in range(dims)]), F.col("bound")))
    found = found.withColumn("dist", exact())
    if limit is not None:
        found = found.filter(F.col("dist") <= limit)
    if k == 1:
        best = found.groupBy("point").agg(F.min(F.struct("dist", order, *[c for c in payload if c != order])).alias("b"))
        return best.select("point", "b.dist", *[F.col(f"b.{c}").alias(c) for c in payload])
    rank = F.row_number().over(per.orderBy("dist", order))
    return found.withColumn("__rank", rank).filter(F.col("__rank") <= k).select("point", "dist", *payload)
