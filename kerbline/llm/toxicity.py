"""Toxicity by maximum-scoring segments.

Tokens have log-odds under Dirichlet priors: a word's prior is its 5-letter beginning's estimate, that one's prior the 4-letter
beginning's, and so on, so an unseen form of a known stem is judged by the stem.  A linear-time scan finds every maximal
scoring segment; Karlin-Altschul statistics fitted to clean texts turn a segment's score into an expected count by chance, and
the evidence of all segments below one is summed and calibrated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut
from .common import fit_line, fold, sample_below, sigmoid

# Hash buckets of the model: its size does not grow with the vocabulary.
BUCKETS = 1 << 20
# Labelled rows used at most (a hash sample of more); the label list is broadcast, so its size is bounded by this.
LABELLED_ROWS = 200_000
# Weight of the prior in documents, and the cost of a token, which makes chance segments short.
PRIOR, DRIFT = 20.0, 0.35
LEVELS = (3, 4, 5)
# Folds: 0 is held out, CALIBRATION sets statistics and thresholds, the others count tokens.
CALIBRATION = 4
MEMO_SIZE, MEMO_CHARS = 300_000, 48
WORD = re.compile(r"\w+")


def buckets(token: str) -> list[int]:
    """Buckets of a token's beginnings and of the token."""
    import xxhash

    return [xxhash.xxh64_intdigest(f"{n}:{token[:n]}".encode("utf-8", "surrogatepass")) % BUCKETS for n in LEVELS] + [xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) % BUCKETS]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), end exclusive, in linear time.

    Each new segment looks back for the nearest kept one that starts lower; if that one ends lower too, all between are one
    segment, and the search goes on from it.  A kept segment remembers its own nearest lower one, so that a search passes over those
    that an earlier one has passed.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, sums before and after, nearest that starts lower
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = i, i + 1, float(total[i]), float(total[i + 1])
        j = len(kept) - 1
        while j >= 0 and kept[j][2] >= low:
            j = kept[j][4]
        while j >= 0 and kept[j][3] < high:
            start, _, low, _, lower = kept[j]
            del kept[j:]
            j = lower
        kept.append((start, end, low, high, j))
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def damped(scores: np.ndarray, tokens: list[str]) -> np.ndarray:
    """A token said again is less evidence each time: its n-th log-odds in a text are an n-th of the first."""
    times: dict[str, int] = {}
    for i in np.flatnonzero(scores > 0).tolist():
        n = times[tokens[i]] = times.get(tokens[i], 0) + 1
        if n > 1:
            scores[i] = (scores[i] + DRIFT) / n - DRIFT
    return scores


@dataclass
class Model:
    toxic: np.ndarray
    clean: np.ndarray
    toxic_docs: int
    clean_docs: int
    decay: float = 1.0
    log_k: float = 0.0
    line: tuple[float, float] = (-2.0, 2.0)
    memo: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def token(self, token: str) -> float:
        """Log-odds of a document with the token against any document, less the cost of a token."""
        base = (self.toxic_docs + 1) / (self.toxic_docs + self.clean_docs + 2)
        share = base
        for b in buckets(token):
            t, c = float(self.toxic[b]), float(self.clean[b])
            share = (t + PRIOR * share) / (t + c + PRIOR)
        return float(np.log(share / (1 - share)) - np.log(base / (1 - base)) - DRIFT)

    def scores(self, tokens: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO_SIZE:
            memo.clear()
        try:
            return np.fromiter(map(memo.__getitem__, tokens), float, len(tokens))
        except KeyError:
            for t in set(tokens):
                if t not in memo:
                    memo[t] = self.token(t)
            got = np.fromiter(map(memo.__getitem__, tokens), float, len(tokens))
            if any(len(t) > MEMO_CHARS for t in tokens):
                for t in {t for t in tokens if len(t) > MEMO_CHARS}:
                    del memo[t]
            return got

    def evidence(self, tokens: list[str]) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Sum over segments of the log of 1 / expected chance segments, and those segments with that number."""
        found = []
        if tokens:
            size = self.log_k + np.log(len(tokens))
            for a, b, s in segments(damped(self.scores(tokens), tokens)):
                log_e = size - self.decay * s
                if log_e < 0:
                    found.append((a, b, s, float(np.exp(log_e))))
        return sum(-np.log(max(e, 1e-300)) for *_, e in found), found

    def probability(self, evidence):
        return sigmoid(self.line[0] + self.line[1] * np.log1p(evidence))


def _tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _count(train: DataFrame) -> DataFrame:
    """``(bucket, toxic, clean)``: documents with a token of the bucket, summed inside each task first; bucket -1 counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), dtype=np.int32)
        docs = [0, 0]
        memo: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1)):
                toxic = int(toxic.as_py())
                docs[toxic] += 1
                hit: set[int] = set()
                for t in set(_tokens(text.as_py())):
                    at = memo.get(t)
                    if at is None:
                        at = buckets(t)
                        if len(memo) >= MEMO_SIZE:
                            memo.clear()
                        memo[t] = at
                    hit.update(at)
                counts[toxic, np.fromiter(hit, np.int64, len(hit))] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[docs[1], counts[1, at]].astype(np.int64)), pa.array(np.r_[docs[0], counts[0, at]].astype(np.int64))], ["bucket", "toxic", "clean"])

    return train.select("text", "toxic").mapInArrow(run, "bucket int, toxic bigint, clean bigint").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _broadcast_map(df: DataFrame, model: Model, fn, schema: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield fn(shared.value, b)

    return df.mapInArrow(run, schema)


def solve_decay(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of E[exp(x s)] = 1; a distribution without positive scores decays as fast as allowed."""
    p = counts / counts.sum()
    low, high = 1e-3, 4.0
    if (p * np.exp(high * values)).sum() <= 1:
        return high
    if (p * values).sum() >= 0:
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    return (low + high) / 2


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", label_key: str = "doc_id", labelled_rows: int = LABELLED_ROWS) -> Model:
    """Token counts, chance statistics and calibration from the labelled rows outside fold 0.

    Labels of null key or value do not count; a document labelled more than once is toxic if half its labels or more are.
    """
    known = (labels.select(F.col(label_key).alias("__key"), F.col(label).cast("int").alias("v")).filter("__key is not null and v is not null")
             .filter(fold(F.col("__key")) != 0).groupBy("__key").agg((F.avg("v") >= 0.5).cast("int").alias("toxic")))
    known = sample_below(cut(known), labelled_rows, "__key")
    train = (docs.select(F.col(key).alias("__k"), F.col(text).alias("text")).join(F.broadcast(known), F.col("__k") == F.col("__key"))
             .select("text", "toxic", fold(F.col("__k")).alias("fold")))
    counted = _count(train.filter(F.col("fold") != CALIBRATION)).toArrow()
    at, toxic, clean = (counted.column(n).to_numpy() for n in ("bucket", "toxic", "clean"))
    arrays = np.zeros((2, BUCKETS), dtype=np.float32)
    real = at >= 0
    arrays[0, at[real]], arrays[1, at[real]] = toxic[real], clean[real]
    model = Model(arrays[0], arrays[1], int(toxic[~real].sum()), int(clean[~real].sum()))

    # scores of calibration documents, once: tokens, their histogram, segments above nothing
    def look(m: Model, b: pa.RecordBatch) -> pa.RecordBatch:
        out = {"toxic": [], "n": [], "bins": [], "counts": [], "segs": []}
        for text, toxic in zip(b.column(0), b.column(1)):
            tokens = _tokens(text.as_py())
            s = damped(m.scores(tokens), tokens)
            bins, counts = np.unique(np.round(s * 20).astype(np.int32), return_counts=True)
            for k, v in zip(out, (toxic.as_py(), len(s), bins.tolist(), counts.tolist(), [x for *_, x in segments(s)])):
                out[k].append(v)
        return pa.RecordBatch.from_arrays([pa.array(out["toxic"], pa.int32()), pa.array(out["n"], pa.int64()), pa.array(out["bins"], pa.list_(pa.int32())), pa.array(out["counts"], pa.list_(pa.int64())), pa.array(out["segs"], pa.list_(pa.float64()))], list(out))

    seen = cut(_broadcast_map(train.filter(F.col("fold") == CALIBRATION).select("text", "toxic"), model, look, "toxic int, n bigint, bins array<int>, counts array<bigint>, segs array<double>"))
    chance = seen.filter("toxic = 0 and n > 0")
    hist = chance.select(F.explode(F.arrays_zip("bins", "counts")).alias("h")).groupBy("h.bins").agg(F.sum("h.counts").alias("n")).collect()
    if hist:
        model.decay = solve_decay(np.array([r.bins / 20 for r in hist]), np.array([float(r.n) for r in hist]))
        # the highest segment of n tokens has mean (log(K n) + Euler's constant) / decay
        top = F.coalesce(F.array_max("segs"), F.lit(0.0))
        mean = chance.select(F.avg(F.lit(model.decay) * top - F.ln("n"))).first()[0]
        model.log_k = float(mean) - 0.5772156649015329
    log_e = F.lit(model.log_k) + F.ln(F.greatest("n", F.lit(1)))
    total = F.aggregate("segs", F.lit(0.0), lambda acc, s: acc + F.greatest(F.lit(0.0), F.lit(model.decay) * s - log_e))
    points = seen.groupBy(F.round(F.log1p(total), 2).alias("x"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    if len({r.toxic for r in points}) == 2:
        slope = fit_line(*(np.array(v, dtype=float) for v in zip(*[(r.x, r.toxic, r.n) for r in points])))
        if slope[1] > 0:
            model.line = slope
    return model


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """Score of a text column, for filters that need no join."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.probability(np.array([shared.value.evidence(_tokens(t))[0] for t in texts], dtype=float)))

    return judge(text)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", passages: bool = False) -> DataFrame:
    """``(key, held_out, score, predicted)``, on demand also ``passages``: code-point spans with score and expected chance count."""
    kind = docs.schema[key].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def judge(m: Model, b: pa.RecordBatch) -> pa.RecordBatch:
        total, spans = [], []
        for t in b.column(1):
            t = t.as_py()
            evidence, found = m.evidence(_tokens(t))
            total.append(evidence)
            if passages:
                at = [x.span() for x in WORD.finditer(t.lower())] if found else []
                spans.append([{"start": at[a][0], "end": at[z - 1][1], "score": s, "expected": e} for a, z, s, e in found])
        columns = [b.column(0), pa.array(m.probability(np.array(total, dtype=float)), pa.float64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(span))] if passages else columns, ["key", "score", "passages"][:2 + passages])

    more = ", passages array<struct<start:bigint,end:bigint,score:double,expected:double>>" if passages else ""
    out = _broadcast_map(docs.select(F.col(key).alias("key"), text), model, judge, f"key {kind}, score double{more}")
    return out.select(F.col("key").alias(key), (fold(F.col("key")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(["passages"] if passages else []))


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit on the labelled rows, then score every row.

    A null or empty text has no evidence and the score that goes with none.  Without labels of both kinds nothing is known
    and every score is the same, below 0.5.  Repeated rows and null keys are scored like others; other columns are ignored.
    """
    return score(docs, fit(docs, labels, key, text), key, text)
