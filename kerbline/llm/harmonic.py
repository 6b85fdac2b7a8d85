"""Harmonic packing of token sequences: bins of one class of lengths hold a fixed number of pieces.

Class ``k`` holds the lengths in ``(capacity/(k+1), capacity/k]`` and its bins hold ``k`` pieces, so no piece needs to know of any other
class, and no worker of any other worker: a bin is closed as soon as its class has ``k`` pieces there.  Documents are cut where that fills bins
exactly: into whole bins, then into halves, quarters, ... of the capacity down to ``SMALLEST``-th parts; what is left of a document is below
that and stays whole, in its own class.  Only bins of those small classes are padded, by less than a ``k+1``-th part.  What a
worker has left in unfilled bins at its end is cut into powers of two and put together, largest first: full bins, then
one sequence per binary digit of the rest, whose lengths are powers of two and need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import ship_code

CAPACITY, END_ID = 1024, 0
# Heads are cut off down to this part of the capacity.
SMALLEST = 16
# Chunks and runs remembered per worker, and the longest of them.
MEMO_SIZE, MEMO_CHARS = 500_000, 48

# Between two signs that are no white space, a single blank always starts a new pre-token.
BREAK = re.compile(r"(?<=\S) (?=\S)")
# Where no other blank stands, every blank is such a one.
OTHER_BLANKS = re.compile(r"\A | \Z| [ \n]|\n |[^\S \n]")
PLAIN = re.compile(r"[\t\n\r -~ÀÖØ-öø-ÿ]+")
# Fixed value: how this vocabulary's pre-tokenizer splits such characters.
RUN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9ÀÖØ-öø-ÿ]+|\s+(?!\S)|\s+")


class ByteIds(dict):
    """Chunk of a text, less the blank before it -> its ids as little-endian unsigned 32-bit bytes.

    Chunks are remembered; a new one of plain characters is put together from its pre-tokens, which repeat more often; any other is asked of the library.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(tokenizer_file)
        self.model, self.little = self.tok.model, [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        self.runs: dict[str, bytes] = {}
        # the model sees bytes as printable characters: those that are none stand behind the last byte, in order
        odd = iter(range(256, 512))
        self.letters = {b: b if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else next(odd) for b in range(256)}
        self.blank = chr(self.letters[32])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.little.__getitem__, self.tok.encode(text, add_special_tokens=False).ids))

    def merge(self, run: str) -> bytes:
        """Ids of one pre-token, its bytes as the model sees them, by the library's merges alone."""
        return b"".join([self.little[t.id] for t in self.model.tokenize(run)])

    def remember(self, memo: dict, text: str, ids: bytes) -> bytes:
        if len(text) <= MEMO_CHARS:
            if len(memo) >= MEMO_SIZE:
                memo.clear()
            memo[text] = ids
        return ids

    def fresh(self, chunk: str) -> bytes:
        """Ids of a chunk with its blank, if it has one."""
        if "<|" in chunk or not PLAIN.fullmatch(chunk):
            return self.encode(chunk)
        parts = []
        for run in RUN.findall(chunk):
            ids = self.runs.get(run)
            parts.append(self.remember(self.runs, run, self.merge(run.encode().decode("latin-1").translate(self.letters))) if ids is None else ids)
        return b"".join(parts)

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():  # one pre-token of letters
            return self.remember(self, chunk, self.merge(self.blank + chunk))
        return self.remember(self, chunk, self.fresh(" " + chunk))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *rest = BREAK.split(text) if OTHER_BLANKS.search(text) else text.split(" ")
        return self.fresh(first) + b"".join(map(self.__getitem__, rest))


_loaded: dict[str, ByteIds] = {}


def byte_ids(tokenizer_file: str) -> ByteIds:
    if tokenizer_file not in _loaded:
        _loaded[tokenizer_file] = ByteIds(tokenizer_file)
    return _loaded[tokenizer_file]


def cuts(length: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [capacity] * (length // capacity)
    left, part = length % capacity, capacity // 2
    while part and part * smallest >= capacity:
        if left >= part:
            out.append(part)
            left -= part
        part //= 2
    return out + [left] * (left > 0)


def digits(length: int) -> list[int]:
    """Powers of two that make up a length, largest first."""
    return [1 << i for i in range(length.bit_length() - 1, -1, -1) if length >> i & 1]


class Bins:
    """Open bins of one worker: a piece is ``(owner, start, ids)``; closed sequences are taken from ``closed``."""

    def __init__(self, capacity: int = CAPACITY, smallest: int = SMALLEST):
        self.capacity, self.smallest = capacity, smallest
        self.open: dict[int, list[tuple]] = {}
        self.closed: list[list[tuple]] = []

    def put(self, owner, start: int, ids: bytes) -> None:
        k = self.capacity // (len(ids) // 4)
        pieces = self.open.setdefault(k, [])
        pieces.append((owner, start, ids))
        if len(pieces) == k:
            self.closed.append(self.open.pop(k))

    def add(self, owner, ids: bytes) -> None:
        at = 0
        for n in cuts(len(ids) // 4, self.capacity, self.smallest):
            self.put(owner, at, ids[4 * at:4 * (at + n)])
            at += n

    @staticmethod
    def odd(piece: tuple) -> bool:
        n = len(piece[2]) // 4
        return n & (n - 1) > 0

    def finish(self) -> None:
        """Close what is open: fewer than ``k`` pieces of each class."""
        tails = [p for pieces in self.open.values() for p in pieces if self.odd(p)]
        self.open = {k: rest for k, pieces in self.open.items() if (rest := [p for p in pieces if not self.odd(p)])}
        for owner, start, ids in tails:
            at = 0
            for n in digits(len(ids) // 4):
                self.put(owner, start + at, ids[4 * at:4 * (at + n)])
                at += n
        left = sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: -len(p[2]))
        self.open = {}
        room, bin_ = self.capacity, []
        for p in left:
            bin_.append(p)
            room -= len(p[2]) // 4
            if not room:
                self.closed.append(bin_)
                room, bin_ = self.capacity, []
        # descending powers of two come to each binary digit of their sum in turn
        for n in digits(self.capacity - room):
            part = []
            while n:
                p = bin_.pop(0)
                part.append(p)
                n -= len(p[2]) // 4
            self.closed.append(part)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, smallest: int = SMALLEST, key: str = "doc_id", text: str = "text", tokenizer_file: str | None = None) -> DataFrame:
    """``(key, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` for every piece of every document.

    A null or empty text is the closing id alone; repeated rows and null keys are packed like others; other columns are ignored; an
    empty table gives no pieces; a very long text is many whole bins.  The capacity is a power of two.  One pass without a shuffle: every
    partition fills bins of its own, and a repeated task fills them alike as long as its rows come in the same order, as those of a scan do.
    """
    if capacity < 1 or capacity & capacity - 1:
        raise ValueError("the capacity must be a power of two")
    ship_code(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        memo = byte_ids(tokenizer_file or public_tokenizers.path("byte_bpe_50k.json"))
        bins, owner_type, number = Bins(capacity, smallest), None, TaskContext.get().partitionId() << 40

        def closed() -> pa.RecordBatch:
            nonlocal number
            rows = []
            for sequence in bins.closed:
                at = 0
                for (owner, tokens), start, ids in sequence:
                    rows.append((owner, start, len(ids) // 4, zlib.crc32(ids), tokens, number, at))
                    at += len(ids) // 4
                number += 1
            bins.closed = []
            cells = zip(*rows) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cells, [owner_type, *[pa.int64()] * 6])], ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            owner_type = b.column(0).type
            for owner, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = memo.ids(t.as_py()) + END_ID.to_bytes(4, "little")
                bins.add((owner, len(ids) // 4), ids)
            yield closed()
        if owner_type is not None:
            bins.finish()
            yield closed()

    out = docs.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("key", key)
