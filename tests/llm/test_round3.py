"""Hard negatives, harmonic packing and centroid clustering against plain Python, on awkward rows too."""

import hashlib
import random
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import centroids, hard_negatives, harmonic

VECTORS = "vec_id bigint, embedding array<double>, label int, id string, tag string, block string, cluster string"
DOCS = "doc_id bigint, text string, length string, offset string, owner string"


def vector_rows(spark, rows):
    return spark.createDataFrame([(i, v, g, "x", None, "y", None) for i, v, g in rows], VECTORS)


def gaussians(n, dim, seed, labels=3, groups=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    x = middle[rng.integers(0, groups, n)] + 0.4 * rng.normal(size=(n, dim))
    return [(int(i), [float(c) for c in r / np.linalg.norm(r)], int(rng.integers(0, labels))) for i, r in enumerate(x)]


ODD_VECTORS = [(None, [0.5] * 8, 1), (900, None, 1), (901, [0.5] * 8, None), (902, [0.5, None] * 4, 1), (903, [float("nan")] * 8, 1), (904, [float("inf")] * 8, 1), (905, [], 1), (906, [0.25] * 3, 1), (1000, [0.0] * 8, 2)]


def brute_negatives(rows, k=5, positives=5):
    kept = {(i, tuple(int(np.floor(256 * c)) for c in v), g) for i, v, g in rows if i is not None and g is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    out = []
    for i, v, g in kept:
        if i % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, h) for j, w, h in kept if j != i and len(v) == len(w))
        for s, p, _ in [x for x in scored if x[2] == g][:positives]:
            window = [(t, n) for t, n, h in scored if h != g and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(i, p, r, n, -s, -t) for r, (t, n) in enumerate(window, 1)]
    return sorted(out)


def mined(df, **more):
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **more)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_negatives_are_those_of_all_pairs(spark, monkeypatch, block):
    """In one block and in many; with ties, repeated rows, rows that take no part and another length."""
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "TOGETHER", 7)
    rows = gaussians(300, 8, 1)
    rows += [(500 + i, rows[i % 4][1], i % 3) for i in range(60)]  # equal vectors under many ids
    rows += rows[:20] + ODD_VECTORS + [(910, [0.25] * 3, 2), (920, [0.25] * 3, 1), (930, [-1.0] + [0.0] * 7, 7), (940, [1.0] + [0.0] * 7, 7)]
    want = brute_negatives(rows)
    assert len(want) > 300
    assert mined(vector_rows(spark, rows)) == want


def test_negatives_of_a_hot_label_and_of_nothing(spark):
    rows = [(i, v, 0 if i % 3 else i) for i, v, _ in gaussians(240, 6, 2)]
    assert mined(vector_rows(spark, rows)) == brute_negatives(rows)
    assert mined(vector_rows(spark, [])) == []
    assert mined(vector_rows(spark, [(10, [1.0], 1)])) == []


def test_large_components(spark):
    """Scores beyond the floats' whole numbers stay exact; what no 64 bits hold is refused."""
    rows = [(i, [1e6 + i * 0.01, -2e6], i % 2) for i in range(30)]
    assert mined(vector_rows(spark, rows)) == brute_negatives(rows)
    with pytest.raises(Exception, match="too large"):
        mined(vector_rows(spark, [(10, [1e300], 1)]))


def test_threshold_stops_early():
    """Long-tailed components let an anchor stop long before it has met all rows."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.laplace(size=(4000, 4)) ** 3).astype(np.int64)
    lists = hard_negatives.Lists(x)
    a = x[:50]
    low = np.full((50, 1), -hard_negatives.FAR)
    key, row, score, scored = hard_negatives.scan(lists, a, low, -low, 5, lambda i, r: i != r)
    assert scored < 0.25 * 50 * 4000
    s = a @ x.T
    s[np.arange(50), np.arange(50)] = -hard_negatives.FAR
    for i in range(50):
        want = np.lexsort((np.arange(4000), -s[i]))[:5]
        assert row[key == i].tolist() == want.tolist()


# 12
@cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def tokens(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


ODD_TEXTS = [None, "", " ", "  ", "\n\n", "a  b", " a", "a ", "a \n b", "it's we'LL  <|endoftext|> x <|endoftext|>", "é ①　▁ x", "word\x85\x1c word", "ab\x00c d", "\x1c x", "don't 123abc--!?\t\tq", "x" * 3000, "w1 " * 5000, "a b c", "ÀÖ÷×µ ª"]


def test_ids_equal_the_library():
    import public_tokenizers

    ids = harmonic.byte_ids(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(5)
    signs = " \t\n\r'abz019.,-!?éÀß÷ñ<|>_①  \x1c\x85中😀"
    texts = [t for t in ODD_TEXTS if t] + ["".join(rnd.choice(signs) if rnd.random() < 0.6 else rnd.choice([" the", "'s", " don't", "  ", "<|endoftext|>", " 12"]) for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(ids.ids(t), "<u4").tolist() == tokens(t), repr(t)


def check_packed(rows, docs, capacity):
    """Every id once and in place, sequences gapless; returns padding and the number of sequences."""
    want = {}
    for i, t in docs:
        ids = [*tokens(t), 0]
        want.setdefault(i, []).append(ids)
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, group in want.items():
        expected = []
        for ids in group:
            at = 0
            for s, n, c, total in sorted(x for x in set(pieces[i]) if x[3] == len(ids)):
                if s == at and c == zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()):
                    expected.append((s, n, c, total))
                    at += n
            assert at == len(ids)
        assert len(group) > 1 or sorted(pieces[i]) == expected
        assert sum(x[1] for x in pieces[i]) == sum(map(len, group))
    padding = 0
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at and n > 0
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, len(seqs)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_harmonic_packing_is_whole_and_tight(spark, capacity):
    rnd = random.Random(7)
    texts = ODD_TEXTS + [" ".join(rnd.choice(["alpha", "beta", "gamma,", "delta.", "x1"]) for _ in range(int(rnd.paretovariate(0.8) * 20) % 4000)) for _ in range(600)]
    docs = list(enumerate(texts)) + [(None, "null key"), (5, "a  b"), (5, "a  b")]
    df = spark.createDataFrame([(i, t, "x", None, "z") for i, t in docs], DOCS).repartition(3)
    rows = harmonic.pack_documents(df, capacity).collect()
    padding, sequences = check_packed(rows, docs, capacity)
    total = sum(r.length for r in rows)
    assert padding <= 0.01 * total
    assert sequences <= 1.02 * total / capacity + 3 * 11
    again = harmonic.pack_documents(df, capacity).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_harmonic_bins_hold_one_class(spark):
    """While documents come, a closed bin holds as many pieces as its class says, all of that class."""
    rnd, bins = random.Random(8), harmonic.Bins(1024, 16)
    for i in range(3000):
        bins.add(i, bytes(4 * rnd.randint(1, 3000)))
    for pieces in bins.closed:
        kinds = {1024 // (len(p[2]) // 4) for p in pieces}
        assert kinds == {len(pieces)}
    assert all(len(v) < k for k, v in bins.open.items())


def test_harmonic_leftovers_are_not_padded():
    rnd = random.Random(9)
    for n in range(60):
        bins = harmonic.Bins(1024, 16)
        for i in range(n * 7):
            bins.add(i, bytes(4 * rnd.randint(1, 40 if n % 2 else 1500)))
        before = len(bins.closed)
        bins.finish()
        sizes = [sum(len(p[2]) // 4 for p in pieces) for pieces in bins.closed[before:]]
        assert all(x & (x - 1) == 0 and x <= 1024 for x in sizes) and sum(x < 1024 for x in sizes) <= 10


def test_harmonic_packing_of_nothing(spark):
    assert harmonic.pack_documents(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        harmonic.pack_documents(spark.createDataFrame([], DOCS), 1000)


# 13
def brute_clusters(rows, k, rounds, dim, scale=64):
    kept = [(i, tuple(int(np.floor(scale * c)) for c in v)) for i, v, _ in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    start = sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:k]
    cents = [list(v) for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for n in range(len(cents)):
            members = [v for (_, v), o in zip(kept, of) if o == n]
            if members:
                cents[n] = [sum(col) // len(members) for col in zip(*members)]
    last = [(i, *nearest(v)) for i, v in kept]
    return sorted((str(i), n, d, sum(y for _, y, m in last if m == n), sum(y for _, y, _ in last), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, d, n in last)


def clustered(df, **more):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.cluster(df, **more).collect())


def test_clusters_are_those_of_full_search(spark):
    rows = gaussians(500, 8, 4) + ODD_VECTORS
    rows += [(600 + i, rows[3][1], 0) for i in range(200)] + [(7, rows[7][1], 1)] * 3  # a third of all rows equal; repeated rows
    got = clustered(vector_rows(spark, rows), clusters=7, dim=8)
    assert got == brute_clusters(rows, 7, 3, 8)


def test_clusters_of_few_equal_and_no_vectors(spark):
    for rows in ([(1, [0.5, 0.25], 0)], [(i, [0.5, 0.25], 0) for i in range(9)], [(i, [float(i % 3), -1.0], 0) for i in range(40)]):
        assert clustered(vector_rows(spark, rows), clusters=4, dim=2) == brute_clusters(rows, 4, 3, 2)
    assert clustered(vector_rows(spark, []), dim=2) == []
    assert clustered(vector_rows(spark, [(1, [1.0], 0), (None, [1.0, 2.0], 0)]), dim=2) == []


def test_ptolemaic_bounds_hold_and_prune():
    rng = np.random.default_rng(9)
    x = rng.integers(-60, 60, (300, 2))[rng.integers(0, 300, 3000)] + rng.integers(-2, 3, (3000, 2))
    cents, pivots = x[:16], centroids.choose_pivots(x[100:160], 4)
    far = centroids.pivot_distances(x, pivots)
    low, high = centroids.bounds(far, pivots, cents)
    d = np.stack([centroids.squared(x, c[None, :]) for c in cents], axis=1)
    assert (low <= d).all() and (d <= high).all()
    cluster, distance, checked = centroids.assign(x, far, pivots, cents)
    assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert checked < 0.25 * d.size
