"""Jump consistent hashing: stable keys to shards without a ring table, in Spark expressions only.

Lamping and Veach's generator is run per key.  The shard under ``n`` shards is the last jump below
``n``, so adding a shard only moves the keys whose next jump lands on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

# Fixed value: multiplier of the generator in the published algorithm.
MULTIPLIER = 2862933555777941757

MASK = 0xFFFFFFFF
# A key makes about ln(shards) jumps; more than this many has a probability below 1e-60 and raises an error.
MAX_JUMPS = 128


def _low_product(a: Column, m: int) -> Column:
    """``a * m`` modulo 2**32 or more (never past 2**50) for ``a`` and ``m`` below 2**32."""
    return a * F.lit(m & 0xFFFF) + F.shiftleft((a * F.lit(m >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The next 64-bit state as two 32-bit halves: bigint products would overflow."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & MASK
    top = lo * F.lit(m_lo >> 16)
    low = lo * F.lit(m_lo & 0xFFFF) + F.shiftleft(top.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    high = F.shiftright(low, 32) + F.shiftright(top, 16) + _low_product(hi, m_lo) + _low_product(lo, m_hi)
    return high.bitwiseAND(F.lit(MASK)), low.bitwiseAND(F.lit(MASK))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard (int, from 0) of a bigint key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key, F.lit(0)).cast("bigint")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(MASK)).alias("lo"),
                     F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def step(s: Column, _) -> Column:
        hi, lo = _advance(s["hi"], s["lo"])
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), jump.cast("bigint").alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    def last(s: Column) -> Column:
        return F.when(s["j"] >= shards, s["b"]).otherwise(F.raise_error(F.lit("jump hash did not settle")).cast("bigint")).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MAX_JUMPS))), start, step, last)


def number_in_shard(df: DataFrame, shard: str, order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 within every shard, along ``order``.

    A shard may hold any share of the rows, so rows are dealt by range and numbered inside their range;
    one count per range and shard supplies the offset.  Equal rows may be numbered in any way.
    """
    tie = "__tie"
    spread = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(F.col(shard), *[F.col(c) for c in order], F.col(tie))
    placed = cut(spread.withColumn("__chunk", F.spark_partition_id()))
    sizes = placed.groupBy("__chunk", shard).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("__chunk").alias("__k"), F.col(shard).alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__chunk", shard).orderBy(*order, tie)
    return (placed.withColumn("__rn", F.row_number().over(inside))
            .join(base, (F.col("__chunk") == F.col("__k")) & (F.col(shard) == F.col("__s")))
            .withColumn(name, F.col("__base") + F.col("__rn") - 1)
            .drop("__chunk", "__k", "__s", "__base", "__rn", tie))


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)`` for every row.

    A null text is empty (size 1, checksum 0), a null key counts as 0, repeated rows each get a slot,
    an empty table gives an empty result, other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), (F.octet_length(body).cast("bigint") + 1).alias("size"), F.crc32(body).alias("text_crc32"),
                       F.lit("key").alias("law"), jump_shard(F.col(key), shards).alias("shard"), jump_shard(F.col(key), shards + 1).alias("grown_shard"))
    return number_in_shard(rows, "shard", [key, "text_crc32", "size"], "slot").select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
