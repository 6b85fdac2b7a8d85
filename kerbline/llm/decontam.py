"""Benchmark decontamination by one Aho-Corasick automaton over word windows of the benchmark.

Texts are lower-cased (A-Z) and reduced to words; every window of 13 words of an item (or a whole shorter item) is one
pattern, and each document is scanned once.  Matches are mapped back to words and to offsets of the original text.
The patterns are broadcast in blocks of a bounded size; a benchmark of any size is a number of such scans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 13
# Bytes of patterns and item ids that one automaton may hold.
BLOCK_BYTES = 8 << 20

#: Bytes outside 0-9, a-z and UTF-8 sequences become spaces; A-Z become a-z.
TABLE = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def windows(ws: list[bytes], size: int = WINDOW) -> Iterator[bytes]:
    """Space-joined windows; a shorter, not empty sequence is one window."""
    for i in range(max(1, len(ws) - size + 1) if ws else 0):
        yield b" ".join(ws[i:i + size])


def benchmark_windows(items: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``(window, items)``: distinct windows with the items they occur in."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(w, k) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for w in dict.fromkeys(windows(words(t), size))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([k for _, k in found], pa.string())], ["window", "item"])

    pairs = items.select(F.col(key).cast("string"), F.col(text).cast("binary")).mapInArrow(cut, "window binary, item string")
    return pairs.filter("item is not null").groupBy("window").agg(F.collect_set("item").alias("items"))


def automaton(patterns: list[tuple[bytes, list[str]]]):
    """Over the bytes as Latin-1 text, each window between spaces so that only whole words match."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for n, (w, _) in enumerate(patterns):
        a.add_word(f" {w.decode('latin-1')} ", (n, w.count(b" ") + 1))
    if len(a):
        a.make_automaton()
    return a


def scan(text: bytes, machine) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Words of a text, word ranges that matches cover (end exclusive, apart from each other), patterns found."""
    ws = words(text)
    if not len(machine) or not ws:
        return len(ws), [], set()
    line = f" {b' '.join(ws).decode('latin-1')} "
    ranges: list[tuple[int, int]] = []
    found: set[int] = set()
    at, n = 0, 0  # words that end at or before ``at``
    for end, (pattern, length) in machine.iter(line):
        n += line.count(" ", at, end)
        at = end
        found.add(pattern)
        start = n - length
        while ranges and ranges[-1][1] >= start:  # a longer match may reach behind earlier ones
            start = min(start, ranges.pop()[0])
        ranges.append((start, n))
    return len(ws), ranges, found


def offsets(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of word ranges."""
    if not ranges:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    out, at, n = [], 0, 0
    for start, end in ((places[a][0], places[b - 1][1]) for a, b in ranges):  # in order and apart: each byte is read once
        n += len(text[at:start].decode("utf-8", "replace"))
        m = n + len(text[start:end].decode("utf-8", "replace"))
        out.append((n, m))
        at, n = end, m
    return out


_built: dict[int, tuple] = {}

_PAIR = "array<struct<start:bigint,end:bigint>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan_block(docs: DataFrame, patterns, only_hits: bool) -> DataFrame:
    """``docs``: key, text as bytes.  The pattern list is a broadcast of a checked size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = patterns.value
        if id(mine) not in _built:
            _built.clear()
            _built[id(mine)] = (mine, automaton(mine))
        machine = _built[id(mine)][1]
        for b in batches:
            keys, keep, n_words, ranges, spans, items = b.column(0), [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                t = t.as_py() or b""
                n, r, found = scan(t, machine)
                if r or not only_hits:
                    keep.append(i)
                    n_words.append(n)
                    ranges.append([{"start": x, "end": y} for x, y in r])
                    spans.append([{"start": x, "end": y} for x, y in offsets(t, r)])
                    items.append(sorted({k for p in found for k in mine[p][1]}))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(at), b.column(2).take(at), pa.array(n_words, pa.int64()), pa.array(ranges, _SPAN), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))],
                                             ["key", "digest", "n_words", "ranges", "spans", "items"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, digest binary, n_words bigint, ranges {_PAIR}, spans {_PAIR}, items array<string>")


def _merged(ranges: Column) -> Column:
    """Union of ranges, in order, as ranges apart from each other."""
    start = F.array().cast(_PAIR)

    def put(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when(last["end"] >= r["start"], F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(ranges), start, put)


def find_contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                       size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(key, n_words, n_hit, n_items, items_sha256, contaminated, items, spans)`` for every document.

    ``spans`` are code-point offsets of the covered passages in the original text.  A null or wordless text has no words and
    is clean; a null item id or text adds no pattern; items of the same text share patterns; repeated rows are kept; an empty
    benchmark leaves all clean.  Other columns are ignored.
    """
    wins = benchmark_windows(items, item_key, item_text, size)
    weight = F.octet_length("window").cast("bigint") + F.aggregate("items", F.lit(0).cast("bigint"), lambda s, i: s + F.octet_length(i)) + 16
    wins = wins.withColumn("__bytes", weight)
    total = wins.agg(F.sum("__bytes")).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes))  # hashing fills blocks unevenly; half full leaves room
    body = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("t"), (F.unhex(F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))) if blocks > 1 else F.lit(None).cast("binary")).alias("digest"))
    context = docs.sparkSession.sparkContext
    parts = []
    for n in range(blocks):
        rows = wins.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == n).select("window", "items").collect()
        patterns = context.broadcast([(bytes(r.window), list(r["items"])) for r in rows])
        parts.append(_scan_block(body, patterns, only_hits=n > 0))
    found = parts[0]
    if blocks > 1:
        rest = parts[0].filter(F.size("ranges") > 0)
        for p in parts[1:]:
            rest = rest.unionByName(p)
        # the same key and text give the same hits, so repeated rows share one entry
        hits = rest.groupBy("key", "digest").agg(*[F.flatten(F.collect_set(c)).alias(c) for c in ("ranges", "spans", "items")])
        hits = hits.select(F.col("key").alias("k"), F.col("digest").alias("d"), *[F.col(c) for c in ("ranges", "spans", "items")])
        on = F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d"))
        found = found.drop("ranges", "spans", "items").join(hits, on, "left").withColumns(
            {"ranges": _merged(F.coalesce("ranges", F.array().cast(_PAIR))), "spans": _merged(F.coalesce("spans", F.array().cast(_PAIR))),
             "items": F.array_distinct(F.coalesce("items", F.array().cast("array<string>")))})
    hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda s, r: s + r["end"] - r["start"])
    return (found.withColumn("n_hit", hit).withColumn("items", F.array_sort("items"))
            .select(F.col("key").alias(key), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items", "spans"))
