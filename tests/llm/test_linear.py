"""Scans whose time follows the length of a text, and what long or odd input gives."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import decontam, html_text, quality, toxicity


def growth(run, small, large):
    """Time of four times the input against that of the input, the least of three tries each."""
    def least(x):
        return min(timed(run, x) for _ in range(3))

    return least(large) / max(least(small), 1e-3)


def timed(run, x):
    t = time.perf_counter()
    run(x)
    return time.perf_counter() - t


def test_segments_in_linear_time():
    rng = np.random.default_rng(1)

    def scores(n):  # falling sums with many rises: every new segment starts lowest
        return np.where(np.arange(n) % 2, -2.0, 1.0) + rng.random(n) / 10

    assert growth(toxicity.segments, scores(20_000), scores(80_000)) < 10


@pytest.mark.parametrize("part", ["<a ", '<a x="', "<div>", "<b>x<p>", "<!x", "</x>", "<p>", "<body>", "<", "<div><p>text, text</p>"])
def test_pages_in_linear_time(part):
    assert growth(html_text.main_text, part * 5000 + ">", part * 20_000 + ">") < 12


def test_offsets_in_linear_time():
    def run(n):
        text = ("wört " * n).encode()
        return decontam.offsets(text, [(i, i + 1) for i in range(0, n, 2)])

    assert growth(run, 5000, 20_000) < 10
    assert run(6) == [(0, 4), (10, 14), (20, 24)]


# op3
FILLER = "This sentence, of some length, says what the story is about, and goes on. " * 3


def brute_score(page):
    """Points of every container by its definition: each paragraph to every ancestor, one by one."""
    root = html_text.parse(page)
    nodes = html_text.walk(root)
    score = {}

    def text_of(n):
        return "".join(p if isinstance(p, str) else "" if p.dropped else text_of(p) for p in n.parts)

    def stripped(n):
        return sum(len(p.strip()) if isinstance(p, str) else 0 if p.dropped else stripped(p) for p in n.parts)

    for n in nodes:
        if n.tag != "p" or not stripped(n):
            continue
        points = 1 + text_of(n).count(",") + min(stripped(n) / 100, 3)
        share, up = 1.0, n.parent
        while up is not None:
            score[id(up)] = score.get(id(up), 0) + points * share
            share, up = share / 2, up.parent
    return {n.tag: score[id(n)] for n in nodes if id(n) in score}


def test_points_are_halved_at_each_ancestor():
    rnd = random.Random(4)
    for _ in range(50):
        depth, page = rnd.randint(1, 6), ""
        tags = ["section", "div", "table", "ul", "blockquote2", "span2"][:depth]
        for t in tags:
            page += f"<{t}>" + "".join(f"<p>{'a, b' * rnd.randint(1, 9)}</p>" for _ in range(rnd.randint(0, 3)))
        page += "<p>x, y</p>" + "".join(f"</{t}>" for t in reversed(tags))
        want = brute_score(page)
        html_text.main_text(page)
        root = html_text.parse(page)
        got = scores_of(root)
        for tag, s in want.items():
            assert got[tag] == pytest.approx(s), (page, tag)


def scores_of(root):
    """Scores without the points of a tag itself, as main_text leaves them."""
    seen = {}
    real = html_text.parse
    try:
        html_text.parse = lambda page: root
        html_text.main_text("x")
    finally:
        html_text.parse = real
    for n in html_text.walk(root):
        if n.score is not None:
            seen[n.tag] = n.score - html_text.TAG_POINTS.get(n.tag, 0)
    return seen


def test_scoring_decides_in_a_marked_article():
    """An article element around menus and a text gives way to the text; around a text it stands for all of it."""
    links = "".join(f'<li><a href="/{i}">Some other story, number {i}, read it</a></li>' for i in range(60))
    page = f'<body><article><div class="x"><ul>{links}</ul></div><div class="y"><p>{FILLER}</p><p>{FILLER}</p></div></article></body>'
    got = html_text.main_text(page)
    assert "says what the story" in got and "other story" not in got
    plain = f"<body><article><h1>Head</h1><div><p>{FILLER}</p></div><p>Short.</p></article><div><p>Elsewhere.</p></div></body>"
    assert html_text.main_text(plain).split("\n\n")[0] == "Head" and html_text.main_text(plain).endswith("Short.")


def test_unfinished_and_open_quotes():
    assert html_text.main_text("<p>one</p><a href='x") == "one"
    assert html_text.main_text('<p>one <a href="x>two</a> three</p>') == "one two three"
    assert html_text.main_text("<p>1 < 2, a <b>c</b></p>") == "1 < 2, a c"


def test_no_pages(spark):
    from kerbline.session import ship_code

    ship_code(spark)
    assert html_text.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string, text string")).count() == 0


# op10
def test_long_words_count_whole():
    word = "".join("A#bcdefghj"[i % 10] for i in range(200_000))
    stats, at, n = quality.look(word, quality.Words())
    assert n == 1 and stats["symbols"] == pytest.approx(0.1) and stats["capitals"] == pytest.approx(1 / 9)
    mixed, _, _ = quality.look(f"plain words {word} HERE {word}", quality.Words())
    text = f"plain words {word} HERE {word}"
    letters, capitals, signs = (len(re.findall(p, text)) for p in ("[A-Za-z]", "[A-Z]", "#"))
    assert mixed["symbols"] == pytest.approx(signs / len(text)) and mixed["capitals"] == pytest.approx(capitals / letters)
    assert quality.shape("a" * 64 + "B1") == "xX0"


def brute_posterior(patterns, rounds=60):
    """Expectation-maximisation written out per pattern, heuristic and class."""
    names = list(patterns)
    total = sum(patterns.values())
    prior = {0: (0.6, 0.05, 0.35), 1: (0.6, 0.38, 0.02)}
    good = {p: 1 / (1 + np.exp(-(1.0 + p.count("1") - 3.0 * p.count("2")))) for p in names}
    for _ in range(rounds):
        weight = {c: {p: patterns[p] * (good[p] if c else 1 - good[p]) for p in names} for c in (0, 1)}
        share = {c: (sum(weight[c].values()) + 1) / (total + 2) for c in (0, 1)}
        table = {}
        for c in (0, 1):
            for i in range(len(names[0])):
                cell = [sum(w for p, w in weight[c].items() if p[i] == str(k)) + 0.02 * total * prior[c][k] for k in range(3)]
                table[c, i] = [x / sum(cell) for x in cell]
        new = {}
        for p in names:
            log = [np.log(share[c]) + sum(np.log(table[c, i][int(v)]) for i, v in enumerate(p) if v != "3") for c in (0, 1)]
            new[p] = 1 / (1 + np.exp(log[0] - log[1]))
        if max(abs(new[p] - good[p]) for p in names) < 1e-7:
            break
        good = new
    return good


def test_posteriors_are_those_of_plain_em():
    rnd = random.Random(11)
    patterns = {"".join(rnd.choice("0123" if rnd.random() < 0.3 else "01") for _ in range(9)): rnd.randint(1, 200) for _ in range(60)}
    got, want = quality.learn_votes(patterns), brute_posterior(patterns)
    assert got.keys() == want.keys()
    assert all(got[p] == pytest.approx(want[p], abs=1e-6) for p in patterns)


def test_votes_of_all_folds_count(spark):
    """The held-out fold's texts shape the posterior too, but not the scorer's sample."""
    from kerbline.llm.common import fold
    from kerbline.session import ship_code

    ship_code(spark)
    good = "the river runs past the old mill and the people of the town walk there every day. "
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(fold(F.col("id")) == 0, F.lit("### !!! @@@ " * 30)).otherwise(F.lit(good * 3)).alias("text"))
    rows = {r.doc_id: r for r in quality.score_documents(df).collect()}
    assert len(rows) == 400 and all(r.predicted == 1 for r in rows.values() if not r.held_out)
    seen = {}
    real = quality.learn_votes
    try:
        quality.learn_votes = lambda patterns: seen.update(patterns) or real(patterns)
        quality.fit(df)
    finally:
        quality.learn_votes = real
    assert sum(seen.values()) == 400


# op2
def test_a_digest_of_most_pages_is_dealt(spark):
    """Nine tenths of the pages are equal: their rows meet the digest in many partitions, no task has over three times the median."""
    from kerbline.llm import warc

    same = "x" * 300
    df = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("y" * 200), F.col("id").cast("string"))).when(F.col("id") % 40 == 1, F.lit("s")).otherwise(F.lit(same)).alias("html"))
    hint, adaptive = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = warc.with_revisits(df)
        sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", hint)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    types = {(r.page_id % 10 == 0 or r.page_id % 40 == 1): set() for r in out.collect()}
    for r in out.collect():
        types[r.page_id % 10 == 0 or r.page_id % 40 == 1].add((r.record_type, r.refers_to))
    assert types[True] == {("response", None)} and types[False] == {("response", None), ("revisit", 2)}
