"""Document quality from overlapping heuristics: a weak-label model and a hashed linear scorer.

Each heuristic calls a text good or bad or abstains.  Expectation-maximisation over the counted vote patterns of all documents
estimates how far each is to be trusted, without any given label; the posterior of a pattern is the soft label of its documents.
A logistic model over hashed word shapes and text statistics learns those and scores every document.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut
from .common import fold, sample_below, sigmoid

# Buckets of word shapes and of statistics, and documents that the scorer is fitted on at most (a hash sample of more).
BUCKETS, SAMPLE_ROWS = 1 << 12, 20_000
MEMO_SIZE, MEMO_CHARS = 300_000, 48
GOOD, BAD, NONE, UNKNOWN = 1, 2, 0, 3
PUNCTUATION = set(".,;:'\"()-!?’‘“”«»¿¡…–—")


def shape(word: str) -> str:
    """Letters as X and x, digits as 0, equal neighbours once (signs twice)."""
    s = "".join("x" if c.islower() else "X" if c.isupper() else "0" if c.isdigit() else "c" if c.isalpha() else c for c in word)
    return re.sub(r"([xX0c])\1+", r"\1", re.sub(r"([^xX0c])\1{2,}", r"\1\1", s))


#: Bits of a word's facts in one number: bucket of its shape, then counts, then flags.  A count that needs more is counted apart.
FIELD, COUNT_BITS = 12, 15
MOST = (1 << COUNT_BITS) - 1


def counts_of(word: str) -> tuple[int, int, int]:
    """Signs, capitals and letters of a word."""
    return sum(not c.isalnum() and c not in PUNCTUATION for c in word), sum(c.isupper() for c in word), sum(c.isalpha() for c in word)


class Words(dict):
    """Word -> its facts packed in a number: a whole text is then one array."""

    def __missing__(self, word: str) -> int:
        import xxhash

        counts = counts_of(word)
        letters = counts[2]
        flags = (word.islower(), re.search(r"[^\w\s]{2}", word.rstrip("\"')»”’")) is not None, letters == 0 and not any(c.isdigit() for c in word), word[-1] in ".!?")
        got = xxhash.xxh64_intdigest(shape(word).encode("utf-8", "surrogatepass")) % BUCKETS
        for k, n in enumerate(counts):
            got |= min(n, MOST) << FIELD + k * COUNT_BITS
        for k, f in enumerate(flags):
            got |= bool(f) << FIELD + len(counts) * COUNT_BITS + k
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[word] = got
        return got


#: Defects: bad above the bound, no opinion below, as lacking one defect says little.
DEFECTS = {"symbols": 0.03, "capitals": 0.3, "repeats": 0.2, "sign_runs": 0.1, "sign_words": 0.1, "length": 0.25, "sentences": 0.6}
#: Virtues: bad below the first bound, good above the second.
VIRTUES = {"variety": (0.15, 0.4), "lower": (0.5, 0.8)}


def look(text: str | None, memo: Words) -> tuple[dict[str, float], np.ndarray, int]:
    """Statistics of a text (each a share), buckets of its words, number of words."""
    ws = text.split() if text else []
    n = len(ws)
    if not n:
        return {}, np.empty(0, dtype=np.int64), 0
    a = np.fromiter(map(memo.__getitem__, ws), np.int64, n)
    counts = [int((a >> FIELD + k * COUNT_BITS & MOST).sum()) for k in range(3)]
    if len(text) > MOST:
        for w in (w for w in ws if len(w) > MOST):
            counts = [have + max(0, true - MOST) for have, true in zip(counts, counts_of(w))]
    signs, capitals, letters = counts
    lower, runs, alone, ends = (int((a >> FIELD + 3 * COUNT_BITS + k & 1).sum()) for k in range(4))
    size = len(text)
    return {"symbols": signs / size, "capitals": capitals / max(1, letters), "repeats": sum(map(operator.eq, ws, ws[1:])) / n, "sign_runs": runs / n,
            "sign_words": alone / n, "variety": len(set(ws)) / n, "lower": lower / n, "length": abs(size / n - 6.0) / 12.0, "sentences": ends / n}, a & BUCKETS - 1, n


def votes(stats: dict[str, float], n: int) -> str:
    """A digit per heuristic; of a few words a share is unknown, which is no evidence, unlike an abstention."""
    out = []
    for name, bad in DEFECTS.items():
        out.append(UNKNOWN if n < 5 else BAD if stats[name] > bad else NONE)
    for name, (bad, good) in VIRTUES.items():
        out.append(UNKNOWN if n < 50 else BAD if stats[name] < bad else GOOD if stats[name] > good else NONE)
    return "".join(map(str, out))


def features(stats: dict[str, float], words: np.ndarray, n: int) -> tuple[list[int], list[float]]:
    """Hashed: root shares of word shapes, and each statistic's step on a fixed ladder."""
    import xxhash

    if not n:
        return [], []
    at, counts = np.unique(words, return_counts=True)
    steps = [xxhash.xxh64_intdigest(f"{name}={int(np.searchsorted((0.002, 0.01, 0.03, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8), v))}".encode()) % BUCKETS for name, v in stats.items()]
    return [*at.tolist(), *(BUCKETS + s for s in steps)], [*np.sqrt(counts / n).tolist(), *([0.5] * len(steps))]


def describe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, votes, at, value)`` in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for b in batches:
            n_words, pattern, at, value = [], [], [], []
            for t in b.column(1):
                stats, words, n = look(t.as_py(), memo)
                i, v = features(stats, words, n)
                n_words.append(n)
                pattern.append(votes(stats, n))
                at.append(i)
                value.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(pattern, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["key", "n_words", "votes", "at", "value"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, n_words bigint, votes string, at array<int>, value array<float>")


def learn_votes(patterns: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Posterior of *good* per vote pattern, by expectation-maximisation over heuristics that are independent given the class.

    The prior, worth a fiftieth of the documents, says that heuristics are better than chance, which tells the classes apart.
    """
    if not patterns:
        return {}
    v = np.array([[int(c) for c in p] for p in patterns])
    n = np.array(list(patterns.values()), dtype=float)
    hot = np.stack([v == k for k in (NONE, GOOD, BAD)], axis=2).astype(float)
    prior = 0.02 * n.sum() * np.array([[0.6, 0.05, 0.35], [0.6, 0.38, 0.02]])  # class bad, class good
    good = sigmoid(1.0 + (v == GOOD).sum(axis=1) - 3.0 * (v == BAD).sum(axis=1))
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good])
        share = (weight.sum(axis=1) + 1) / (n.sum() + 2)
        table = np.einsum("cp,plk->clk", weight, hot) + prior[:, None, :]
        table /= table.sum(axis=2, keepdims=True)
        log = np.log(share)[:, None] + np.einsum("plk,clk->cp", hot, np.log(table))
        new = sigmoid(log[1] - log[0])
        if np.abs(new - good).max() < 1e-7:
            break
        good = new
    return dict(zip(patterns, good.tolist()))


def fit_scorer(at: np.ndarray, value: np.ndarray, row: np.ndarray, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic model on soft labels, by gradient steps of adapted size."""
    size = 2 * BUCKETS + 1
    w, m, s = np.zeros(size), np.zeros(size), np.zeros(size)
    rows = max(1, len(target))
    for k in range(1, rounds + 1):
        p = sigmoid(np.bincount(row, value * w[at], rows)[:len(target)] + w[-1])
        err = p - target
        g = np.bincount(at, value * err[row], size) / rows + 1e-5 * w
        g[-1] = err.sum() / rows
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-9)
    return w


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, DataFrame]:
    """Weights of the scorer, and the described documents that it was learned from."""
    seen = cut(describe(docs, key, text))
    # votes need no label, so all documents count; the scorer leaves fold 0 out
    learn = seen.filter(fold(F.col("key")) != 0)
    posterior = learn_votes({r.votes: r.n for r in seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()})
    sample = sample_below(learn.filter("n_words > 0"), sample_rows, "key", "n_words").select("votes", "at", "value").toArrow()
    lists = sample.column("at").combine_chunks()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())) if len(lists) else np.empty(0, dtype=np.int64)
    target = np.array([posterior[p] for p in sample.column("votes").to_pylist()])
    return fit_scorer(lists.flatten().to_numpy().astype(np.int64), sample.column("value").combine_chunks().flatten().to_numpy().astype(float), row, target), seen


def score_column(spark: SparkSession, weights: np.ndarray, text: Column) -> Column:
    """Score of a text column, for filters that need no join."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo, w = Words(), shared.value
        for texts in batches:
            z = []
            for t in texts:
                at, value = features(*look(t, memo))
                z.append(float(np.dot(w[at], value)) + w[-1] if at else w[-1])
            yield pd.Series(sigmoid(np.array(z)))

    return score(text)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(key, held_out, score, predicted)`` for every row; no given label is used, votes are counted over all rows, and fold 0 is left out of fitting the scorer.

    A null or empty text and one of a few words carry no sign against them and score as the intercept says.  Repeated rows and
    null keys are scored like others; other columns are ignored; an empty table gives an empty result; of very long texts and words every character counts.
    """
    weights, seen = fit(docs, key, text, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            at, value = b.column(1), b.column(2)
            row = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
            z = np.bincount(row, value.flatten().to_numpy() * w[at.flatten().to_numpy()], len(at)) + w[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(z))], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    out = seen.select("key", "at", "value").mapInArrow(run, f"key {kind}, score double")
    return out.select(F.col("key").alias(key), (fold(F.col("key")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
