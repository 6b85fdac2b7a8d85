"""Approximate nearest neighbours: a graph built by NN-descent, searched greedily.

Vectors of equal direction are one node.  Nodes are compared by squared distance of unit vectors held as floats, so that those
very close to each other are still told apart (1 - cosine of floats would round to nothing).  The graph starts from blocks of nodes that are close along random directions; then every node compares
the nodes around it with each other (neighbours of neighbours), whatever is better than a node's worst neighbour travels to it,
and the rounds end when few neighbours change.  A query walks the graph with a beam of its best nodes until none of
them leads on; its best nodes, and all of the beam that the floats cannot tell from them, are ranked by the exact cosine.  Each round is cut in shared storage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut

# Neighbours of a node, and how many a node may offer to one other in one meeting.
DEGREE, OFFERS = 32, 8
# Rows of a starting block, directions of them, share of changed neighbours at which the graph is good.
BLOCK, DIRECTIONS, SETTLED = 1024, 3, 0.12
# Nodes in a query's beam, followed at once, ranked exactly besides ties.
BEAM, STRIDE, EXACT = 192, 48, 48
# Nodes in a row of the search table: a batch of rows stays small.
PIECE = 16
# Bytes of query vectors searched together: what is broadcast is bounded by it, not by the table.
QUERY_BYTES = 16 << 20
# Directions that agree to so many parts of one are equal; a distance is off by less than ROUNDING, as either end is rounded to floats.
STEPS, ROUNDING = 1e12, 2.0**-22


def group_numbers(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of a sorted key."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
    return first, np.diff(np.r_[first, len(key)])


def best(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's ``k`` most similar others, most similar first; the first of equal pairs counts."""
    order = np.lexsort((np.arange(len(owner)), other, owner))
    same = np.r_[False, (owner[order][1:] == owner[order][:-1]) & (other[order][1:] == other[order][:-1])] if len(order) else np.empty(0, bool)
    order = order[~same]
    order = order[np.lexsort((other[order], -sim[order], owner[order]))]
    first, size = group_numbers(owner[order])
    return order[np.arange(len(order)) - np.repeat(first, size) < k]


def floats(cells: list[bytes], dim: int) -> np.ndarray:
    """Binary cells of unit vectors of ``dim`` floats as rows."""
    return np.frombuffer(b"".join(cells), dtype=np.float32).reshape(-1, dim).astype(np.float64)


def closeness(x: np.ndarray) -> np.ndarray:
    """Negative squared distances between the rows, -9 of a row to itself."""
    n = np.einsum("ij,ij->i", x, x)
    d = np.minimum(2 * (x @ x.T) - n[:, None] - n[None, :], 0)
    np.fill_diagonal(d, -9)
    return d


def lists(values: np.ndarray, owner: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per run of a sorted owner."""
    first, _ = group_numbers(owner)
    return pa.ListArray.from_arrays(pa.array(np.r_[first, len(owner)].astype(np.int32)), pa.array(values, kind))


def whole_groups(batches: Iterator[pa.RecordBatch], shrink) -> Iterator[pa.Table]:
    """Tables that end where a run of the first column ends; ``shrink`` keeps a run that spans batches small."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
        key = t.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield t.slice(0, last).combine_chunks()
        held = shrink(t.slice(last).combine_chunks())
    if held is not None:
        yield held


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, vec)`` of the rows that take part, whatever their length."""
    v = F.col(vector)
    good = v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(key).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(key).alias("id"), v.cast("array<double>").alias("vec"))


def directed(rows: DataFrame, dim: int) -> DataFrame:
    """``(id, vec, dir)`` of the rows with ``dim`` parts: the direction is the same for a vector and its multiples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                steps = np.rint(unit(b.column(1)) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in steps], pa.binary())], ["id", "vec", "dir"])

    return rows.filter(F.size("vec") == dim).mapInArrow(run, f"id {dict(rows.dtypes)['id']}, vec array<double>, dir binary")


def index_nodes(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """``(node, dir, vec, ids, q, p0..)`` per distinct direction: its least ids, the least one's vector, its floats, its places along random directions; the dimension."""
    rows = usable(vectors, key, vector)
    common = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    dim = common.d if common else 1
    rows = directed(rows, dim)
    # the least ids of a vector are gathered in parts first: it may be any share of the rows
    parts = max(16, -(-(common.n if common else 0) // 10_000))
    few = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, 6)
    first = F.min(F.struct("id", "vec"))
    some = rows.groupBy("dir", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(first.alias("first"), F.slice(F.array_sort(F.collect_set("id")), 1, 6).alias("ids"))
    distinct = some.groupBy("dir").agg(F.min("first").alias("first"), few.alias("ids"))
    directions = np.random.default_rng(7).standard_normal((dim, DIRECTIONS)).astype(np.float32)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = unit(b.column(2)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in q], pa.binary()), *[pa.array(p) for p in (q @ directions).T]],
                                                 ["node", "dir", "vec", "ids", "q", *[f"p{i}" for i in range(DIRECTIONS)]])

    kind = dict(vectors.dtypes)[key]
    numbered = distinct.select(F.monotonically_increasing_id().alias("node"), "dir", F.col("first.vec").alias("vec"), "ids")
    return cut(numbered.mapInArrow(mark, f"node bigint, dir binary, vec array<double>, ids array<{kind}>, q binary, {', '.join(f'p{i} float' for i in range(DIRECTIONS))}")), dim


def unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_OFFER = "u bigint, vs array<bigint>, sims array<float>"


def start_offers(nodes: DataFrame, dim: int, degree: int, block: int) -> DataFrame:
    """Best others of each node within blocks along each random direction."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_n: list[np.ndarray] = []
        held_q: list[bytes] = []

        def emit(node: np.ndarray, q: list[bytes]) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(node), block):
                me = node[a:a + block]
                if len(me) > 1:
                    d = closeness(floats(q[a:a + block], dim))
                    k = min(degree, len(me) - 1)
                    at = np.argpartition(-d, k - 1, axis=1)[:, :k]
                    yield pa.RecordBatch.from_arrays([pa.array(me), lists(me[at].ravel(), np.repeat(np.arange(len(me)), k), pa.int64()), lists(np.take_along_axis(d, at, 1).ravel().astype(np.float32), np.repeat(np.arange(len(me)), k), pa.float32())], ["u", "vs", "sims"])

        for b in batches:
            held_n.append(b.column(0).to_numpy())
            held_q += b.column(1).to_pylist()
            if len(held_q) >= 2 * block:
                n, full = np.concatenate(held_n), len(held_q) // block * block - block
                yield from emit(n[:full], held_q[:full])
                held_n, held_q = [n[full:]], held_q[full:]
        if held_q:
            yield from emit(np.concatenate(held_n), held_q)

    out = None
    for i in range(DIRECTIONS):
        part = nodes.select("node", "q", f"p{i}").repartitionByRange(f"p{i}").sortWithinPartitions(f"p{i}").select("node", "q").mapInArrow(meet, _OFFER)
        out = part if out is None else out.unionByName(part)
    return out


_GRAPH = "node bigint, q binary, vs array<bigint>, sims array<float>, fresh array<boolean>, worst float"


def merge_offers(graph: DataFrame, offers: DataFrame, degree: int) -> DataFrame:
    """The graph with each node's best of old neighbours and offers; new ones are fresh."""

    def read(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        vs, sims = t.column(2).combine_chunks(), t.column(3).combine_chunks()
        size = np.diff(vs.offsets.to_numpy())
        old = np.array(t.column(1).combine_chunks().is_valid())
        return np.repeat(t.column(0).to_numpy(), size), vs.flatten().to_numpy(), sims.flatten().to_numpy(), np.repeat(old, size)

    def fold(t: pa.Table) -> tuple:
        u, v, s, old = read(t)
        order = np.argsort(~old, kind="stable")  # an offer that is known already stays known
        at = order[best(u[order], v[order], s[order], degree)]
        at = at[v[at] != u[at]]
        q = t.filter(t.column(1).combine_chunks().is_valid())
        return u[at], v[at], s[at], old[at], q

    def shrink(t: pa.Table) -> pa.Table:
        if t.num_rows < 4096:
            return t
        u, v, s, old, q = fold(t)
        bare = pa.table({"u": u[~old], "q": pa.nulls(int((~old).sum()), pa.binary()), "vs": pa.array([[x] for x in v[~old]], pa.list_(pa.int64())), "sims": pa.array([[x] for x in s[~old]], pa.list_(pa.float32()))})
        return pa.concat_tables([q.rename_columns(bare.column_names), bare]).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, shrink):
            u, v, s, old, q = fold(t)
            own = q.column(0).to_numpy()
            order = np.argsort(own)
            n = np.searchsorted(u, own[order], "right") - np.searchsorted(u, own[order], "left")
            offset = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
            worst = np.where(n >= degree, s[np.maximum(np.cumsum(n) - 1, 0)] if len(s) else 0, -9).astype(np.float32)
            vectors = q.column(1).combine_chunks().take(pa.array(order))
            yield pa.RecordBatch.from_arrays([pa.array(own[order]), vectors, *[pa.ListArray.from_arrays(offset, pa.array(x)) for x in (v, s, ~old)], pa.array(worst)], ["node", "q", "vs", "sims", "fresh", "worst"])

    known = graph.select(F.col("node").alias("u"), "q", "vs", "sims")
    both = known.unionByName(offers.select("u", F.lit(None).cast("binary").alias("q"), "vs", "sims"))
    return cut(both.repartition("u").sortWithinPartitions("u").mapInArrow(run, _GRAPH))


def around(graph: DataFrame) -> DataFrame:
    """``(c, m, sim, fresh, out, q, worst)``: around every node its neighbours and the nodes whose neighbour it is."""
    each = graph.select("node", "q", "worst", F.explode(F.arrays_zip("vs", "sims", "fresh")).alias("e"))
    back = each.select(F.col("e.vs").alias("c"), F.col("node").alias("m"), F.col("e.sims").alias("sim"), F.col("e.fresh").alias("fresh"), F.lit(False).alias("out"), "q", "worst")
    ahead = graph.select(F.col("node").alias("c"), F.explode(F.arrays_zip("vs", "sims", "fresh")).alias("e")).select("c", F.col("e.vs").alias("m"), F.col("e.sims").alias("sim"), F.col("e.fresh").alias("fresh"), F.lit(True).alias("out"))
    ahead = ahead.join(graph.select(F.col("node").alias("m"), "q", "worst"), "m").select(*back.columns)
    return back.unionByName(ahead)


def meet_around(graph: DataFrame, dim: int, degree: int, offers: int, turn: int) -> DataFrame:
    """Offers between the nodes around each node, at least one of a pair being fresh.

    Of a node that very many have for a neighbour, a hash sample of those takes part in a turn: another one each turn.
    """

    def thin(t: pa.Table) -> pa.Table:
        out = t.column(4).to_numpy()
        if len(out) - out.sum() <= degree:
            return t
        h = (t.column(1).to_numpy().astype(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
        key, order = t.column(0).to_numpy(), np.lexsort((h ^ (h >> np.uint64(29)), out, t.column(0).to_numpy()))
        first, size = group_numbers(key[order])
        rank = np.arange(len(order)) - np.repeat(first, size)
        return t.take(pa.array(np.sort(order[(rank < degree) | out[order]])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, thin):
            t = thin(t).combine_chunks()
            x, m = floats(t.column(5).to_pylist(), dim), t.column(1).to_numpy()
            fresh, worst = t.column(3).to_numpy(), t.column(6).to_numpy()
            us, vs, ss, rows = [], [], [], []
            for a, n in zip(*group_numbers(t.column(0).to_numpy())):
                _, at = np.unique(m[a:a + n], return_index=True)
                at += a
                f = fresh[at]
                k = min(offers, len(at) - 1)
                if k < 1 or not f.any():
                    continue
                d = closeness(x[at])
                d[~(f[:, None] | f[None, :])] = -9
                top = np.argpartition(-d, k - 1, axis=1)[:, :k]
                sim = np.take_along_axis(d, top, 1)
                ok = sim > np.maximum(worst[at], -8)[:, None]
                i, j = np.nonzero(ok)
                us.append(m[at][i])
                vs.append(m[at][top[i, j]])
                ss.append(sim[i, j])
                rows.append(i + (rows[-1][-1] + 1 if rows and len(rows[-1]) else 0))
            if us:
                u, v, s, r = (np.concatenate(z) for z in (us, vs, ss, rows))
                r = np.r_[0, np.cumsum((u[1:] != u[:-1]) | (r[1:] != r[:-1]))] if len(u) else r
                first, _ = group_numbers(r)
                yield pa.RecordBatch.from_arrays([pa.array(u[first]), lists(v, r, pa.int64()), lists(s.astype(np.float32), r, pa.float32())], ["u", "vs", "sims"])

    return around(graph).repartition("c").sortWithinPartitions("c").mapInArrow(run, _OFFER)


def build_graph(nodes: DataFrame, dim: int, degree: int = DEGREE, offers: int = OFFERS, block: int = BLOCK, settled: float = SETTLED) -> DataFrame:
    """NN-descent: ``(node, q, vs, sims, fresh, worst)``, neighbours most similar first."""
    empty = nodes.select("node", "q", F.array().cast("array<bigint>").alias("vs"), F.array().cast("array<float>").alias("sims"))
    graph = merge_offers(empty, start_offers(nodes, dim, degree, block), degree)
    turn = 0
    while True:
        turn += 1
        graph = merge_offers(graph, meet_around(graph, dim, degree, offers, turn), degree)
        new, all_ = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("fresh"))).first()
        if not all_ or new < settled * all_:
            return graph


def search_table(graph: DataFrame, dim: int, degree: int = DEGREE) -> DataFrame:
    """``(node, vs, qs)``: the most similar nodes around each, with their floats, so that a step needs no other rows; a row has ``PIECE`` of them."""

    def closest(t: pa.Table) -> pa.Table:
        if t.num_rows <= 2 * degree:
            return t
        return t.take(pa.array(best(t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy(), 2 * degree)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, closest):
            c, m, q = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(3).to_pylist()
            at = best(c, m, t.column(2).to_numpy(), 2 * degree)
            first, size = group_numbers(c[at])
            row = np.cumsum((np.arange(len(at)) - np.repeat(first, size)) % PIECE == 0)
            first, size = group_numbers(row)
            yield pa.RecordBatch.from_arrays([pa.array(c[at][first]), lists(m[at], row, pa.int64()), pa.array([b"".join([q[i] for i in at[a:a + n]]) for a, n in zip(first, size)], pa.binary())], ["node", "vs", "qs"])

    return cut(around(graph).select("c", "m", "sim", "q").repartition("c").sortWithinPartitions("c").mapInArrow(run, "node bigint, vs array<bigint>, qs binary"))


_STATE = "query bigint, ids array<bigint>, sims array<float>, done array<boolean>, ahead array<bigint>, worst float"


def walk(spark: SparkSession, table: DataFrame, nodes: np.ndarray, vectors: np.ndarray, dim: int, beam: int, stride: int) -> DataFrame:
    """``(query, ids, sims)``: the beam of each query node after greedy search from itself; ``nodes`` is sorted."""
    shared = spark.sparkContext.broadcast((nodes, vectors))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, x = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            q, worst = b.column(0).to_numpy(), b.column(1).to_numpy()
            mine = x[np.searchsorted(known, q)]
            size = np.diff(b.column(2).offsets.to_numpy())
            owner, cells, sim = np.repeat(np.arange(len(q)), size), b.column(3), []
            for a in range(0, len(q), 256):
                apart = floats(cells.slice(a, 256).to_pylist(), dim) - np.repeat(mine[a:a + 256], size[a:a + 256], axis=0)
                sim.append(-np.einsum("ij,ij->i", apart, apart))
            sim = np.concatenate(sim).astype(np.float32)
            ok = sim > worst[owner]
            first, _ = group_numbers(owner[ok])
            yield pa.RecordBatch.from_arrays([pa.array(q[owner[ok][first]]), lists(b.column(2).flatten().to_numpy()[ok], owner[ok], pa.int64()), lists(sim[ok], owner[ok], pa.float32())], ["query", "ids", "sims"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, lambda t: t):
            ids, sims, done = (t.column(i).combine_chunks() for i in (1, 2, 3))
            size = np.diff(ids.offsets.to_numpy())
            q, v, s = np.repeat(t.column(0).to_numpy(), size), ids.flatten().to_numpy(), sims.flatten().to_numpy()
            d = np.zeros(len(v), dtype=bool)
            d[np.repeat(np.array(done.is_valid()), size)] = done.flatten().to_numpy(zero_copy_only=False).astype(bool)
            order = np.argsort(~d, kind="stable")  # of a node met again, what was followed counts
            at = order[best(q[order], v[order], s[order], beam)]
            q, v, s, d = q[at], v[at], s[at], d[at]
            first, size = group_numbers(q)
            todo = np.cumsum(~d) - np.repeat((np.cumsum(~d) - ~d)[first], size)
            go = ~d & (todo <= stride)
            worst = np.where(size >= beam, s[first + size - 1], -9).astype(np.float32)
            n = np.add.reduceat(go.astype(np.int64), first)
            ahead = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(v[go], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(q[first]), lists(v, q, pa.int64()), lists(s, q, pa.float32()), lists(d | go, q, pa.bool_()), ahead, pa.array(worst)], ["query", "ids", "sims", "done", "ahead", "worst"])

    state = spark.createDataFrame(pa.table({"query": nodes})).select("query", F.array("query").alias("ids"), F.array(F.lit(0.0).cast("float")).alias("sims"), F.array(F.lit(True)).alias("done"), F.array("query").alias("ahead"), F.lit(-9.0).cast("float").alias("worst"))
    while True:
        front = state.select("query", "worst", F.explode("ahead").alias("node"))
        # at most `stride` short rows for each query of the block are broadcast
        offers = F.broadcast(front).join(table, "node").select("query", "worst", "vs", "qs").mapInArrow(step, "query bigint, ids array<bigint>, sims array<float>")
        both = state.select("query", "ids", "sims", "done").unionByName(offers.withColumn("done", F.lit(None).cast("array<boolean>")))
        state = cut(both.repartition("query").sortWithinPartitions("query").mapInArrow(keep, _STATE))
        if state.filter(F.size("ahead") > 0).isEmpty():
            return state.select("query", "ids", "sims")


def rank_exactly(nodes: DataFrame, found: DataFrame, query_nodes: np.ndarray, query_vectors: np.ndarray, exact: int, most: int) -> DataFrame:
    """``(query, near)``: for each query node the ``most`` nearest ids with their exact cosine, nearest first, then least id."""
    shared = nodes.sparkSession.sparkContext.broadcast((query_nodes, query_vectors))
    # with the first of the beam go all that are no farther than the last of them but for rounding
    last = F.sqrt(-F.get("sims", F.least(F.size("sims"), F.lit(exact)) - 1).cast("double")) + 2 * ROUNDING
    tied = F.filter(F.arrays_zip("ids", "sims"), lambda e: F.sqrt(-e["sims"].cast("double")) <= last)
    pairs = found.select("query", F.explode(tied["ids"]).alias("node"))

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, x = shared.value
        for b in batches:
            if b.num_rows:
                q = b.column(0).to_numpy()
                a = x[np.searchsorted(known, q)]
                z = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(q), -1)
                sim = np.array([float(np.dot(i, j) / (np.linalg.norm(i) * np.linalg.norm(j))) for i, j in zip(a, z)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sim), b.column(2)], ["query", "score", "ids"])

    kind = nodes.schema["ids"].dataType.simpleString()
    scored = F.broadcast(pairs).join(nodes.select("node", "vec", "ids"), "node").select("query", "vec", "ids").mapInArrow(cosine, f"query bigint, score double, ids {kind}")
    each = scored.select("query", F.explode("ids").alias("id"), "score").select("query", F.struct((-F.col("score")).alias("far"), "id").alias("at"))
    return each.groupBy("query").agg(F.slice(F.array_sort(F.collect_list("at")), 1, most).alias("near"))


def nearest(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", degree: int = DEGREE, beam: int = BEAM, stride: int = STRIDE, exact: int = EXACT) -> DataFrame:
    """``(query_id, rank, <key>, score)``: the ``k`` nearest other rows found for each row with ``is_query``.

    Vectors that are null or zero or hold a null, a NaN or an infinite part take no part, nor do rows with a null key or with
    another length than most.  Vectors of equal direction are told apart by the least key; a row given twice is one row.  With ``k`` candidates or
    fewer all are returned; an empty table gives an empty result.  Other columns are ignored.
    """
    if k > 5:
        raise ValueError("a node keeps six ids, enough for five neighbours")
    spark = vectors.sparkSession
    nodes, dim = index_nodes(vectors, key, vector)
    graph = build_graph(nodes, dim, degree)
    table = search_table(graph, dim, degree)
    asked = (directed(usable(vectors.filter(is_query), key, vector), dim).select(F.col("id").alias("query_id"), "dir").distinct()
             .join(nodes.select("node", "dir"), "dir").select("query_id", "node"))
    asked = cut(asked)
    targets = cut(asked.select("node").distinct().join(nodes.select("node", "vec"), "node"))
    n = targets.count()
    blocks = max(1, -(-n * dim * 8 * 2 // QUERY_BYTES))
    out = None
    for i in range(blocks):
        rows = targets.filter(F.pmod(F.xxhash64("node"), F.lit(blocks)) == i).toArrow()
        if not rows.num_rows:
            continue
        order = np.argsort(rows.column("node").to_numpy())
        q_nodes = rows.column("node").to_numpy()[order]
        q_vectors = rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)[order]
        scaled = q_vectors / np.abs(q_vectors).max(axis=1, keepdims=True)
        found = walk(spark, table, q_nodes, scaled / np.linalg.norm(scaled, axis=1, keepdims=True), dim, beam, stride)
        near = rank_exactly(nodes, found, q_nodes, q_vectors, exact, k + 1)
        part = asked.join(F.broadcast(near), F.col("node") == F.col("query"))
        out = part if out is None else out.unionByName(part)
    kind = dict(vectors.dtypes)[key]
    if out is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score double")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return (out.select("query_id", F.posexplode(others).alias("p", "x"))
            .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias(key), (-F.col("x.far")).alias("score")))
