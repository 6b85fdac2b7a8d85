"""Best-fit packing of token sequences by large-item matching.

Only lengths matter to a packing, and there are at most ``capacity`` of them, so the plan is made on a histogram: a table whose
size does not grow with the data.  Lengths above a third of the capacity are matched greedily in pairs (at most two fit), smaller
ones then fill the tightest gaps.  Rows take their places by their number within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut

CAPACITY = 4096
END_ID = 1
# Pre-tokens and words remembered per worker.
MEMO_SIZE, MEMO_CHARS = 500_000, 48
# Rows numbered by one task, about.
NUMBER_ROWS = 100_000


class WordIds(dict):
    """White-space-separated word -> its ids as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space before merging, so a text's ids are its words' ids in order.  Words are asked for whole;
    plain ones are assembled from their letter and sign runs, which repeat far more often.
    """

    def __init__(self, tokenizer_file: str):
        import re

        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(tokenizer_file)
        self.runs: dict[str, bytes] = {}
        #: Characters that neither normalisation rewrites but for their case; anything else goes to the library whole.
        self.plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
        # Fixed value: how this vocabulary's pre-tokenizer splits such characters.
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
        self.model, self.little = self.tok.model, [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        # the model sees bytes as printable characters: those that are none stand behind the last byte, in order
        odd = iter(range(256, 512))
        self.letters = {b: b if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else next(odd) for b in range(256)}
        #: The model may be asked without the steps before it if it answers alike for every plain character.
        plain = [chr(c) for c in (*range(33, 127), *range(0xC0, 0x100)) if chr(c) not in "×÷"]
        self.direct = all(self.merge(f"{c.lower()}{c.lower()}") == self.encode(f"{c}{c}") for c in plain if len(self.split.findall(f"{c}{c}".lower())) == 1)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.little.__getitem__, self.tok.encode(text, add_special_tokens=False).ids))

    def merge(self, run: str) -> bytes:
        """Ids of one pre-token of plain characters, by the library's merges alone."""
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.little[t.id] for t in self.model.tokenize(run)])

    def __missing__(self, word: str) -> bytes:
        if "<|" in word or not self.plain.fullmatch(word):
            got = self.encode(word)
        else:
            parts = []
            for run in self.split.findall(word.lower()):
                ids = self.runs.get(run)
                if ids is None:
                    ids = self.merge(run) if self.direct else self.encode(run)
                    if len(run) <= MEMO_CHARS:
                        if len(self.runs) >= MEMO_SIZE:
                            self.runs.clear()
                        self.runs[run] = ids
                parts.append(ids)
            got = b"".join(parts)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[word] = got
        return got

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to split(), not to the library
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


_loaded: dict[str, WordIds] = {}


def word_ids(tokenizer_file: str) -> WordIds:
    if tokenizer_file not in _loaded:
        _loaded[tokenizer_file] = WordIds(tokenizer_file)
    return _loaded[tokenizer_file]


def tokenize_pieces(docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", tokenizer_file: str | None = None) -> DataFrame:
    """``(key, piece, start, length, ids_crc32)``: a document's ids and a closing id, cut every ``capacity`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        memo = word_ids(tokenizer_file or public_tokenizers.path("word_bpe_49k.json"))
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = memo.ids(t.as_py()) + END_ID.to_bytes(4, "little")
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                                             ["key", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint").withColumnRenamed("key", key)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """``(length, first, count, sequence, offset)``: items ``first .. first+count-1`` of a length open at ``offset`` in
    ``sequence, sequence+1, ...``.

    Full and large items open sequences, largest first, each large one with the largest partner left that fits; a length
    above a third of the capacity shares a sequence with one more such item at most.  Smaller items, largest first, go to
    the sequences with the smallest gap that takes them, as many at a time as fit there, and open new ones when none does.
    """
    left = Counter({n: c for n, c in histogram.items() if c})
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("a length lies outside the capacity")
    used: Counter = Counter()
    out: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted gaps that have open sequences
    open_: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (sequence, count)
    sequences = 0

    def place(length: int, sequence: int, count: int, offset: int) -> None:
        out.append((length, used[length], count, sequence, offset))
        used[length] += count
        left[length] -= count

    def leave(gap: int, sequence: int, count: int) -> None:
        if gap:
            if gap not in open_:
                insort(gaps, gap)
                open_[gap] = []
            open_[gap].append((sequence, count))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect_right(large, min(a, capacity - a)) - 1
            while at >= 0 and not left[large[at]] - (large[at] == a):
                at -= 1
            if at < 0:
                n = left[a]
                place(a, sequences, n, 0)
                leave(capacity - a, sequences, n)
            else:
                b = large[at]
                n = left[a] // 2 if a == b else min(left[a], left[b])
                place(a, sequences, n, 0)
                place(b, sequences, n, a)
                leave(capacity - a - b, sequences, n)
            sequences += n
    for a in sorted((n for n in left if left[n]), reverse=True):
        while left[a]:
            at = bisect_left(gaps, a)
            if at == len(gaps):
                each = min(left[a], capacity // a)
                n = left[a] // each
                for k in range(each):
                    place(a, sequences, n, k * a)
                leave(capacity - each * a, sequences, n)
                sequences += n
                continue
            gap = gaps[at]
            sequence, count = open_[gap].pop()
            each = min(gap // a, left[a])
            n = min(count, left[a] // each)
            for k in range(each):
                place(a, sequence, n, capacity - gap + k * a)
            leave(gap - each * a, sequence, n)
            if n < count:
                open_[gap].append((sequence + n, count - n))
            elif not open_[gap]:
                del open_[gap], gaps[gaps.index(gap)]
    return out


def number_by_length(pieces: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 0) within ``length``; a common length is numbered in many parts."""
    total = pieces.count()
    salts = max(1, -(-total // NUMBER_ROWS)) * 8
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("length").alias("__l"), F.col("__salt").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("length", "__salt").orderBy(*order)
    return (salted.withColumn("__rn", F.row_number().over(inside)).join(base, (F.col("length") == F.col("__l")) & (F.col("__salt") == F.col("__s")))
            .withColumn("rank", F.col("__base") + F.col("__rn") - 1).drop("__salt", "__l", "__s", "__base", "__rn"))


def place_pieces(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length``; the plan table is bounded by the capacity alone."""
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = sorted(plan(histogram, capacity))
    # equal lengths are cut at the same ranks, so a row finds its step by a lookup in its length's array
    rows = spark.createDataFrame(steps, "length bigint, first bigint, count bigint, sequence bigint, offset bigint")
    per = rows.groupBy(F.col("length").alias("__l")).agg(F.array_sort(F.collect_list(F.struct("first", "count", "sequence", "offset"))).alias("__steps"))
    step = F.filter("__steps", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["first"] + s["count"]))[0]
    return (number_by_length(pieces, order).join(F.broadcast(per), F.col("length") == F.col("__l")).withColumn("__step", step)
            .withColumns({"sequence_id": F.col("__step.sequence") + F.col("rank") - F.col("__step.first"), "offset": F.col("__step.offset")})
            .drop("__l", "__steps", "__step", "rank"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", tokenizer_file: str | None = None) -> DataFrame:
    """``(key, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of every document.

    A null or empty text is the closing id alone; only documents longer than ``capacity`` are cut; repeated rows and null keys
    are packed like others; other columns are ignored; an empty table gives no pieces.
    """
    pieces = cut(tokenize_pieces(docs, capacity, key, text, tokenizer_file))
    return place_pieces(pieces, [key, "piece", "ids_crc32"], capacity).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
