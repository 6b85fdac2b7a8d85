"""Ordered (lag, running) computations that do not need a whole group in one task.

A plain window sorts a complete partition in one task, so one flight or kerb with a third of
all rows would stall the job.  Here each group is cut along its order into chunks; windows run
inside chunks, a per-chunk summary (a few rows per group) is scanned, and its carry is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import col


def chunk_of(value, width: float) -> Column:
    """Chunk number of a numeric order value."""
    return F.floor(col(value) / F.lit(float(width))).cast("bigint")


def chunk_of_time(ts, seconds: float) -> Column:
    micros = F.timestamp_diff("MICROSECOND", F.lit("2000-01-01").cast("timestamp_ntz"), col(ts))
    return F.floor(micros / F.lit(seconds * 1e6)).cast("bigint")


def ordered_scan(
    df: DataFrame,
    by: list[str],
    order: list,
    chunk: Column,
    lag: dict[str, str | Column] | None = None,
    lead: dict[str, str | Column] | None = None,
    running_sum: dict[str, Column] | None = None,
    prior_max: dict[str, Column] | None = None,
    prior_min: dict[str, Column] | None = None,
    later_min: dict[str, Column] | None = None,
    row_number: str | None = None,
    total: dict[str, Column] | None = None,
) -> DataFrame:
    """Add window columns to every row of ``df``.

    ``order`` must be total within a group and ``chunk`` must not decrease along it.
    ``lag``/``lead`` name the neighbour's value, ``running_sum`` includes the row itself,
    ``prior_max``/``prior_min`` look at earlier rows only, ``later_min`` at later rows only,
    ``total`` is the sum over the whole group.
    """
    lag, lead, total = lag or {}, lead or {}, total or {}
    sums, pmax, pmin, lmin = running_sum or {}, prior_max or {}, prior_min or {}, later_min or {}
    if row_number:
        sums = {**sums, row_number: F.lit(1).cast("bigint")}
    order = [col(o) for o in order]

    exprs: dict[str, Column] = {}
    for group in (lag, lead, sums, pmax, pmin, lmin, total):
        for name, e in group.items():
            exprs[f"__in_{name}"] = col(e)
    base = df.withColumns({**exprs, "__chunk": chunk})
    keys = [*by, "__chunk"]
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(1, Window.unboundedFollowing)

    local: dict[str, Column] = {}
    for n in lag:
        local[f"__has_{n}"] = F.lag(F.lit(True)).over(w)
        local[n] = F.lag(f"__in_{n}").over(w)
    for n in lead:
        local[f"__has_{n}"] = F.lead(F.lit(True)).over(w)
        local[n] = F.lead(f"__in_{n}").over(w)
    local.update({n: F.sum(f"__in_{n}").over(upto) for n in sums})
    local.update({n: F.max(f"__in_{n}").over(before) for n in pmax})
    local.update({n: F.min(f"__in_{n}").over(before) for n in pmin})
    local.update({n: F.min(f"__in_{n}").over(after) for n in lmin})
    rows = base.withColumns(local)

    # one summary row per chunk
    pos = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    aggs = []
    if lag:
        aggs.append(F.max_by(F.struct(*[F.col(f"__in_{n}").alias(n) for n in lag]), pos).alias("__last"))
    if lead:
        aggs.append(F.min_by(F.struct(*[F.col(f"__in_{n}").alias(n) for n in lead]), pos).alias("__first"))
    aggs += [F.sum(f"__in_{n}").alias(f"__sum_{n}") for n in sums]
    aggs += [F.max(f"__in_{n}").alias(f"__max_{n}") for n in pmax]
    aggs += [F.min(f"__in_{n}").alias(f"__min_{n}") for n in pmin]
    aggs += [F.min(f"__in_{n}").alias(f"__lmin_{n}") for n in lmin]
    aggs += [F.sum(f"__in_{n}").alias(f"__tot_{n}") for n in total]
    aggs.append(F.count(F.lit(1)).alias("__n"))
    cw = Window.partitionBy(*by).orderBy("__chunk")
    cprev, cnext = cw.rowsBetween(Window.unboundedPreceding, -1), cw.rowsBetween(1, Window.unboundedFollowing)
    carry: dict[str, Column] = {}
    if lag:
        carry["__c_last"] = F.lag("__last").over(cw)
    if lead:
        carry["__c_first"] = F.lead("__first").over(cw)
    carry.update({f"__c_{n}": F.sum(f"__sum_{n}").over(cprev) for n in sums})
    carry.update({f"__c_{n}": F.max(f"__max_{n}").over(cprev) for n in pmax})
    carry.update({f"__c_{n}": F.min(f"__min_{n}").over(cprev) for n in pmin})
    carry.update({f"__c_{n}": F.min(f"__lmin_{n}").over(cnext) for n in lmin})
    carry.update({f"__c_{n}": F.sum(f"__tot_{n}").over(Window.partitionBy(*by)) for n in total})
    summary = base.groupBy(*keys).agg(*aggs).withColumns(carry).select(*[F.col(k).alias(f"__k_{k}") for k in keys], *carry)

    joined = rows.join(summary, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], "left")
    out: dict[str, Column] = {}
    for n in lag:
        out[n] = F.when(F.col(f"__has_{n}"), F.col(n)).otherwise(F.col(f"__c_last.{n}"))
    for n in lead:
        out[n] = F.when(F.col(f"__has_{n}"), F.col(n)).otherwise(F.col(f"__c_first.{n}"))
    for n in sums:
        out[n] = F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"__c_{n}"), F.lit(0))
    for n in pmax:
        out[n] = F.greatest(F.col(n), F.col(f"__c_{n}"))
    for n in [*pmin, *lmin]:
        out[n] = F.least(F.col(n), F.col(f"__c_{n}"))
    for n in total:
        out[n] = F.col(f"__c_{n}")
    fresh = [n for n in out if n not in df.columns]
    return joined.withColumns(out).select(*df.columns, *fresh)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, salt: Column, salts: int = 32) -> DataFrame:
    """First ``k`` rows of every key; hot keys are reduced in ``salts`` pieces first."""
    part = F.pmod(F.xxhash64(salt), F.lit(salts))
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn("__salt", part).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return kept.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).drop("__salt")


def latest_per_key(df: DataFrame, keys: list[str], order: Column, newest: bool = True) -> DataFrame:
    """The row with the greatest (or least) ``order`` per key, combined map-side."""
    pick = F.max_by if newest else F.min_by
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(pick(whole, order).alias("__row")).select("__row.*")


def global_number(df: DataFrame, order: list, name: str, start: int | Column = 0, ranges: int = 0) -> DataFrame:
    """Consecutive numbers over the whole table without one task sorting it all.

    Rows are range-partitioned and materialised once, so partition sizes and row ranks agree.
    """
    from ..session import cut

    order = [col(o) for o in order]
    spread = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    placed = cut(spread.withColumn("__chunk", F.spark_partition_id().cast("bigint")))
    w = Window.partitionBy("__chunk").orderBy(*order)
    sizes = placed.groupBy("__chunk").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition, so this window is as small as the partition count
    before = Window.partitionBy("__one").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("__one", F.lit(0)).select(F.col("__chunk").alias("__k"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    start = F.lit(start) if isinstance(start, int) else start
    return (placed.withColumn("__rn", F.row_number().over(w))
            .join(base, F.col("__chunk") == F.col("__k"))
            .withColumn(name, F.col("__rn") + F.col("__base") + start)
            .drop("__chunk", "__k", "__rn", "__base"))
