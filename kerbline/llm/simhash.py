"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Fingerprints at ``max_bits`` (4) differing bits share at least four of their eight bytes in place.  The index is keyed by three byte
positions and their values: the positions are chosen so that every four positions include an indexed three, so every such pair
meets under some key.  There the shared positional bytes of a pair are tallied, pairs with fewer than the guaranteed four go, and the
rest are verified.  Only links that connect are written, never all pairs of a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..session import cut

SHINGLE, SEED, MAX_BITS, BYTES = 4, 42, 4, 8
# Shingles hashed at a time, so that a long text needs no more memory than a short one.
CHUNK = 1 << 16
# Keys of at most SMALL rows are compared by shifts; one task holds about LARGE rows of a key.
SMALL, LARGE = 8, 8192

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' XXH64; a text without words has 0."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    ws = text.translate(_LOWER).split()
    if not ws:
        return 0
    n = max(1, len(ws) - shingle + 1)
    line = b" ".join(ws)
    gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    stop = [*gaps[shingle - 1:].tolist(), len(line)]
    start = [0, *(gaps[:n - 1] + 1).tolist()]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(start[at:at + CHUNK], stop[at:at + CHUNK])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(key, fp)``; the 64 bits as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t.as_py() or b"", shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("t")).mapInArrow(run, f"key {kind}, fp bigint").withColumnRenamed("key", key)


def byte_groups() -> list[tuple[int, int, int]]:
    """Positions in threes so that any four of the eight hold one of them.

    The positions form a ring of three parts; indexed are threes inside a part and threes with two in a part and one in
    the next.  Four positions over three parts put two or more in one, and each such case holds an indexed three.
    """
    part = [p * 3 // BYTES for p in range(BYTES)]
    out = []
    for t in combinations(range(BYTES), 3):
        c = [sum(part[p] == k for p in t) for k in range(3)]
        if 3 in c or any(c[k] == 2 and c[(k + 1) % 3] == 1 for k in range(3)):
            out.append(t)
    return out


def near(a: np.ndarray, b: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Tally shared positional bytes, then verify the pairs with enough of them."""
    x = np.atleast_1d(a ^ b)
    hit = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= BYTES - max_bits
    hit[hit] = np.bitwise_count(x[hit]) <= max_bits
    return hit


def connect(members: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that join exactly what all links among ``members`` join: each member is reached once."""
    out, rest = [], members
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            hit = near(rest, at, max_bits)
            if hit.any():
                new = rest[hit]
                out += [(int(at), int(n)) for n in new]
                frontier.extend(new)
                rest = rest[~hit]
    return out


def _links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> np.ndarray:
    """Links among rows of equal key; rows are sorted by key."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    found = []
    small = np.repeat(size <= SMALL, size)
    for d in range(1, min(SMALL, len(keys))):
        at = np.flatnonzero((keys[d:] == keys[:-d]) & small[:-d])
        if not len(at):
            break
        at = at[near(fps[at], fps[at + d], max_bits)]
        found.append(np.stack([fps[at], fps[at + d]], axis=1))
    for f, n in zip(first[size > SMALL], size[size > SMALL]):
        found.append(np.array(connect(fps[f:f + n], max_bits), dtype=np.uint64).reshape(-1, 2))
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.empty((0, 2), dtype=np.uint64)


def link_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS, large: int = LARGE) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``fp`` whose components are those of all links."""
    if BYTES - max_bits < 4:
        raise ValueError("the index is made for at most four differing bits")
    groups = byte_groups()

    def byte(p: int):
        return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))

    keys = F.array(*[F.lit(n << 24) + F.shiftleft(byte(i), 16) + F.shiftleft(byte(j), 8) + byte(k) for n, (i, j, k) in enumerate(groups)])
    index = distinct.select("fp", F.explode(keys).alias("key"))
    hot = cut(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select(F.col("key").alias("hot"), F.ceil(F.col("n") / large).cast("int").alias("parts")))
    # a large key is dealt in parts, and every two parts meet in one cell
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1), lambda x: F.least(x, part) * F.col("parts") + F.greatest(x, part)))
    dealt = index.join(hot, F.col("key") == F.col("hot"), "left").select("key", F.explode(cells).alias("cell"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            ab = _links(keys, fps, max_bits).astype(np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            k, c, f = (b.column(i).to_numpy() for i in range(3))
            k, f = (k.astype(np.int64) << 32) | c, f.view(np.uint64)
            if held and held[0][0][0] == k[-1]:
                held.append((k, f))
                continue
            k, f = np.concatenate([*[h[0] for h in held], k]), np.concatenate([*[h[1] for h in held], f])
            last = int(np.searchsorted(k, k[-1]))
            held = [(k[last:], f[last:])]
            if last:
                yield done(k[:last], f[:last])
        if held:
            yield done(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    return dealt.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``(key, fingerprint, component_id)`` for every row; the id is the least key that links reach, copies included.

    Equal fingerprints meet in one row before any comparison, so copies cost nothing and nothing of them is lost.  A null or
    wordless text has fingerprint 0 and is linked like any other; a null key never names a component that has another key.
    Repeated rows are kept, other columns ignored.
    """
    marked = cut(fingerprints(docs, key, text))
    distinct = cut(marked.groupBy("fp").agg(F.min(key).alias("least")))
    # a node is named by its least key (then its bits), so a component's least node carries the component's id
    name = F.struct(F.col("least").isNull().alias("none"), "least", "fp")
    links = link_fingerprints(distinct.select("fp"), max_bits)
    for end in ("a", "b"):
        links = links.join(distinct.select(F.col("fp").alias(end), name.alias(f"{end}_node")), end)
    labels = connected_components(distinct.select(name.alias("node")), links, node="node", a="a_node", b="b_node")
    per = labels.select(F.col("node.fp").alias("f"), F.col("label.least").alias("component_id"))
    return marked.join(per, F.col("fp") == F.col("f")).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
