"""The training-data operators against plain Python, round trips and held-out labels, on awkward rows too."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import decontam, html_text, neighbours, packing, quality, sharding, simhash, token_count, toxicity, warc
from kerbline.session import ship_code

DOCS = "doc_id bigint, text string, size string, shard string, key string, rank int"
ODD = [None, "", " ", "\n\n", "a", "One two.", "one TWO.", "x " * 5000, "it's  <|endoftext|> é ①　▁▁x", "word\x85\x1cword", "ab\x00c", "'LL don't"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns whose names the operators use."""
    ship_code(spark)
    rows = [(i, t, "x", None, "k", 1) for i, t in enumerate(ODD)] + [(None, "null key", "x", "y", None, None), (5, "One two.", "x", None, "k", 1), (5, "One two.", "x", None, "k", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(seed, n, vocabulary=400):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


# 1
def brute_segments(s):
    """Every maximal scoring segment by its definition: best of what is left and right of the best, again and again."""
    out = []

    def go(a, b):
        best = max(((sum(s[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 1e-12:
            return
        i = -best[2]
        j = i - best[1]
        out.append((i, j))
        go(a, i)
        go(j, b)

    go(0, len(s))
    return sorted(out)


def test_segments_are_all_maximal_ones():
    rnd = random.Random(3)
    for _ in range(200):
        s = [rnd.choice([-2.0, -1.0, -0.5, 0.75, 1.25, 2.5]) + rnd.random() / 100 for _ in range(rnd.randint(0, 14))]
        assert [x[:2] for x in toxicity.segments(np.array(s, dtype=float))] == brute_segments(s)


def labelled(spark, n=600, bad=("nasty", "vile", "foul")):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        ws = words(i, 60)
        if toxic:
            for k in range(3):
                ws[7 + 11 * k] = bad[(i + k) % 3] + ("" if i % 2 else "ness")
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_held_out(spark, odd, none):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model, passages=True).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in got)
    assert all(got[i].predicted == int(i % 5 == 0) for i in held)
    p = got[5].passages[0]
    text = " ".join(words(5, 60))
    assert p.end > p.start and len(text) > 0 and p.expected < 1
    assert len(toxicity.score(odd, model).collect()) == odd.count() and toxicity.score(none, model).count() == 0
    assert toxicity.score(odd, model).filter("score is null or score < 0 or score > 1").count() == 0


def test_toxicity_without_labels(spark, odd):
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id bigint, toxic int")
    assert {r.predicted for r in toxicity.score_documents(odd, labels).collect()} == {0}


def test_unseen_form_of_a_known_stem(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    assert model.token("nastyhood") > 1 and model.token("w1") < 0.5


# 2
def pages(spark):
    big = "<p>" + "y" * 200 + "é</p>\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n"
    return [(7, "http://a/\r\nX: y", big), (3, "u", big), (9, None, big), (1, "v", "short"), (2, "v", "short"), (4, "w", None), (5, "w", ""), (3, "u", big), (None, "n", "alone " * 30), (None, "n", big)]


def test_warc_round_trip(spark):
    rows = pages(spark)
    ship_code(spark)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("record_type", F.lit("clash"))
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(df).collect())
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [k for k, _, x in rows if x == h and k is not None]
        rev = len(b) >= 100 and sum(x == h for *_, x in rows) > 1 and i != min(same, default=None) and bool(same)
        want.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if rev else "response", min(same) if rev else None))
    assert got == sorted(want)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_warc_skips_what_is_not_asked_for(spark, tmp_path):
    ship_code(spark)
    df = spark.createDataFrame(pages(spark)[:8], "page_id bigint, url string, html string")
    path = str(tmp_path / "w")
    warc.write_warc(warc.with_revisits(df), path, compression="none")
    reader = warc.WarcReader(warc.read_warc(spark, path, payload=False).schema, {"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringStartsWith(("record_id",), "<urn:page:7"), GreaterThan(("content_length",), 1)]))
    assert len(rest) == 1 and isinstance(rest[0], GreaterThan)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["record_id"] for r in rows] == ["<urn:page:7>"] and "payload" not in rows[0]
    assert len(warc.WarcReader(warc.read_warc(spark, path).schema, {"path": path, "partitionBytes": "1"}).partitions()) >= 1
    gz = str(tmp_path / "gz")
    warc.with_revisits(df).select("html").limit(0)
    warc.read_warc(spark, path).filter("record_type = 'response'").count()
    import gzip
    import os

    os.makedirs(gz)
    for n, f in enumerate(sorted(x for x in os.listdir(path) if x.startswith("part"))):
        with gzip.open(f"{gz}/{n}.gz", "wb") as z, open(f"{path}/{f}", "rb") as src:
            z.write(src.read())
    assert warc.read_warc(spark, gz).count() == 8


# 3
def test_main_text_keeps_the_article():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><h1>Site</h1></header><nav><a href=x>menu</a></nav>
    <div id="cookie-notice"><p>We use cookies, many, many, many of them.</p></div><div class="layout"><main><article class="post"><h1>Head &amp; line</h1>
    <p>First, with <a href=y>a link</a>,\n and\tspace.<br>Same block.<p>Second<script>var x = "</p>";</script> one, unclosed<ul><li>point one<li>point two</ul>
    <aside>aside, aside, aside</aside><div class="ad">buy</div><form><p>your mail</p><input></form></article></main>
    <div class="sidebar"><p>side, side, side, side</p></div><section id="comments"><p>nice, nice, nice, nice, nice, nice</p></section></div><footer>foot</footer></body></html>"""
    assert html_text.main_text(page) == "Head & line\n\nFirst, with a link, and space. Same block.\n\nSecond one, unclosed\n\npoint one\n\npoint two"


def test_main_text_of_plain_containers_and_siblings():
    p = "Long enough, a sentence, with commas, to be counted as text of the page here."
    page = f"<body><div class=menu><a href=a>x</a></div><div id=wrap><div><p>{p}</p><p>{p}</p><p>{p}</p></div><div><p>{p}</p><p>{p}</p></div><div><a href=1>l</a> <a href=2>m</a></div></div>"
    assert html_text.main_text(page) == "\n\n".join([p] * 5)


def test_main_text_of_odd_pages(spark, odd):
    assert [html_text.main_text(x) for x in (None, "", "<", "a < b", "<p", "<p>x<!-- y", "<script>z", "plain", "<b>&lt;i&gt;</b>")] == ["", "", "<", "a < b", "", "x", "", "plain", "<i>"]
    deep = html_text.main_text("<div>" * 5000 + "deep" + "</div>" * 5000)
    assert deep == "deep"
    got = html_text.extract_pages(odd.withColumnsRenamed({"doc_id": "page_id", "text": "html", "size": "url"}))
    assert got.count() == odd.count() and got.filter("text is null or n_chars <> char_length(text)").count() == 0


# 4
def test_token_counts_equal_the_library(spark, odd, none):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab B\n \t▁é中😀<s>.'0  x") for _ in range(rnd.randint(0, 50))) for _ in range(800)] + [t for t in ODD if t is not None]
    s = token_count.shortcut(public_tokenizers.path("piece_bpe_32k.model"))
    assert s.cuts and [s.count(t) for t in texts] == [len(sp.encode(t)) for t in texts]
    got = token_count.count_tokens(odd).collect()
    assert len(got) == odd.count() and {(r.n_bytes, r.n_tokens) for r in got if r.doc_id in (0, 1)} == {(0, 0)}
    assert [r.over_limit for r in got if r.doc_id == 7] == [True] and token_count.count_tokens(none).count() == 0


# 5
def test_packing_is_whole_and_tight(spark, odd, none):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack_documents(odd, capacity=64).collect()
    want = []
    for i, t, *_ in odd.collect():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(str(i), p, a, len(ids[a:a + 64]), zlib.crc32(np.array(ids[a:a + 64], dtype="<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 64))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 64
    assert len(seqs) <= -(-sum(r.length for r in got) // 64) + 1
    assert packing.pack_documents(none).count() == 0


def test_large_items_are_matched_best():
    """As many pairs as any matching has: against trying all."""
    from functools import cache

    rnd = random.Random(6)
    for _ in range(40):
        items = tuple(sorted(rnd.choice([35, 40, 45, 50, 55, 60, 65, 70, 90]) for _ in range(rnd.randint(0, 8))))
        h = {n: items.count(n) for n in set(items)}

        @cache
        def fewest(rest):
            if not rest:
                return 0
            one = 1 + fewest(rest[1:])
            return min([one, *(1 + fewest(rest[1:i] + rest[i + 1:]) for i in range(1, len(rest)) if rest[0] + rest[i] <= 100)])

        opened = {s + k for _, _, c, s, _ in packing.plan(h, 100) for k in range(c)}
        assert len(opened) == fewest(items)


# 6
def py_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, odd, none):
    keys = [0, 1, -1, 2**62, -(2**63), *range(2, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for n in (1, 8, 9, 1000):
        assert {r.k: r.s for r in df.select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect()} == {k: py_jump(k % 2**64, n) for k in keys}
    got = sharding.shard_documents(odd).collect()
    assert len(got) == odd.count() and all(r.grown_shard in (r.shard, 8) for r in got)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {(r.size, r.text_crc32) for r in got if r.doc_id in (0, 1)} == {(1, 0)} and sharding.shard_documents(none).count() == 0


# 7
def test_neighbours_find_nearly_all(spark):
    ship_code(spark)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 24)).round(3)
    x[200:700] = x[200]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [1.0] * 3), (None, [1.0] * 24), (5200, [None] * 24), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("node", F.lit("clash"))
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 50))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, near in got.items():
        near.sort()
        s = unit @ unit[q]
        assert [n for n, *_ in near] == [1, 2, 3, 4, 5] and q not in [v for _, v, _ in near]
        assert all(abs(s[v] - c) < 1e-12 for _, v, c in near)
        assert near == sorted(near, key=lambda t: (-t[2], t[1]))
        if 200 <= q < 700:
            assert [v for _, v, _ in near] == [i for i in range(200, 207) if i != q][:5]
        s[q] = -9
        hit += len({v for _, v, _ in near} & set(np.lexsort((np.arange(1500), -s))[:5].tolist())) if not 200 <= q < 700 else 5
    assert hit >= 0.95 * 5 * len(got)


def test_neighbours_among_near_and_scaled_copies(spark):
    """Groups of other vectors than the beam holds: near copies at three distances, multiples of one vector."""
    ship_code(spark)
    rng = np.random.default_rng(11)
    base = rng.standard_normal((5, 64))
    near = [base[g] / np.linalg.norm(base[g]) + rng.standard_normal((400, 64)) / 8 * d for g, d in enumerate((0.15, 0.014, 1e-4))]
    scaled = base[3] * rng.uniform(0.01, 100, (400, 1))
    x = np.concatenate([*near, scaled, rng.standard_normal((400, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = [0] * 5
    for q, ids in got.items():
        far = np.linalg.norm(unit - unit[q], axis=1)
        far[q] = 9
        want = np.argsort(far)[:5].tolist() if not 1200 <= q < 1600 else [i for i in range(1200, 1206) if i != q][:5]
        hit[q // 400] += len(set(ids) & set(want))
    assert len(got) == 100 and min(hit) >= 0.95 * 5 * 20, hit


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 0"), F.col("vec_id") == 0).count() == 0


# 8
def brute_contamination(docs, items):
    def ws(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    wins = {}
    for k, t in items:
        w = ws(t)
        if k is not None and w:
            for i in range(max(1, len(w) - 12)):
                wins.setdefault(tuple(w[i:i + 13]), set()).add(str(k))
    out = []
    for d, t in docs:
        w, hit, found = ws(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i:i + n])]
        out.append((str(d), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 2000])
def test_contamination(spark, odd, none, block):
    items = [(i, " ".join(words(i, 20 + i))) for i in range(6)] + [(10, "W1 w2-w3"), (11, "one"), (12, None), (None, "one two"), (13, ""), (2, " ".join(words(2, 22))), (14, "Été 中文")]
    docs = [(i, t) for i, t in enumerate(ODD)] + [(20, f"{' '.join(words(50, 30))} {', '.join(words(3, 23)).upper()}; {' '.join(words(51, 300))}"), (21, " ".join(words(1, 21)[:12])), (22, " ".join(words(1, 21) + words(2, 22))),
                                                  (23, "x w1 w2 w3 w1-w2.w3 Y"), (24, "ein Été 中文"), (22, " ".join(words(1, 21) + words(2, 22))), (None, "one")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("items", F.lit(1))
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.find_contamination(d, b, block_bytes=block)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == brute_contamination(docs, items)
    r = got.filter("doc_id = 20").first()
    passage = docs[len(ODD)][1][r.spans[0].start:r.spans[0].end]
    assert r.spans and passage.lower().split(", ")[0] in words(3, 23)
    assert decontam.find_contamination(none, b).count() == 0 and decontam.find_contamination(d, b.limit(0)).filter("contaminated").count() == 0


# 9
def test_byte_groups_meet_every_four():
    from itertools import combinations

    groups = [set(g) for g in simhash.byte_groups()]
    assert all(any(g <= set(c) for g in groups) for c in combinations(range(8), 4))


@pytest.mark.parametrize("large", [simhash.LARGE, 16])
def test_links_connect_what_all_links_connect(spark, large):
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = list({b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(rnd.choice([1, 2, 60]))})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp bigint")
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, f in enumerate(fps):
        for g in fps[:i]:
            if (f ^ g).bit_count() <= 4:
                parent[root(f)] = root(g)
    want = sorted(sorted(g for g in fps if root(g) == r) for r in {root(f) for f in fps})
    ship_code(spark)
    mine = {f: f for f in fps}

    def top(f):
        while mine[f] != f:
            f = mine[f]
        return f

    for r in simhash.link_fingerprints(df, large=large).collect():
        a, b = r.a % 2**64, r.b % 2**64
        assert (a ^ b).bit_count() <= 4
        mine[top(a)] = top(b)
    assert sorted(sorted(g for g in fps if top(g) == r) for r in {top(f) for f in fps}) == want


def test_near_duplicates(spark, odd, none):
    import xxhash

    got = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert got[0].fingerprint == "0" * 16 and got[0].component_id == got[1].component_id == got[3].component_id == 0
    assert got[5].component_id == got[6].component_id == 5 and simhash.near_duplicates(odd).count() == odd.count()
    assert int(got[5].fingerprint, 16) == xxhash.xxh64_intdigest("one two.", 42)
    base = words(1, 400)
    docs = [(i, " ".join([*base[:300 + i], "x", *base[301 + i:]])) for i in range(30)] + [(100 + i, " ".join(words(200 + i, 200))) for i in range(20)]
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    fp = {r.doc_id: int(r.fingerprint, 16) for r in got}
    label = {d: d for d in fp}
    for _ in fp:
        label = {d: min(label[e] for e in fp if (fp[d] ^ fp[e]).bit_count() <= 4) for d in fp}
    assert {r.doc_id: r.component_id for r in got} == label
    assert simhash.near_duplicates(none).count() == 0


# 10
def junk(i):
    ws = words(i, 80)
    return [" ".join(f"{w}%%%" for w in ws), " ".join(ws).upper().replace(" ", "!! "), " | ".join(ws), " ".join([ws[0]] * 80)][i % 4]


def test_quality_without_labels(spark, odd, none):
    ship_code(spark)

    def prose(i):
        ws = [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words(i, 120, 5000)]
        return ". ".join(" ".join(ws[k:k + 10]).capitalize() for k in range(0, 120, 10)) + "."

    rows = [(i, junk(i) if i % 6 == 0 else prose(i)) for i in range(900)]
    got = quality.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 900 and sum(r.predicted == int(r.doc_id % 6 != 0) for r in got) >= 890
    assert quality.score_documents(odd).filter("score between 0 and 1").count() == odd.count()
    assert quality.score_documents(none).count() == 0
    weights, _ = quality.fit(odd)
    assert odd.withColumn("s", quality.score_column(spark, weights, F.col("text"))).filter("s between 0 and 1").count() == odd.count()


def test_votes_are_weighed():
    posterior = quality.learn_votes({"000000011": 800, "200200011": 60, "002000021": 50, "333333333": 10})
    assert posterior["000000011"] > 0.9 and posterior["333333333"] > 0.5 and max(posterior["200200011"], posterior["002000021"]) < 0.1
