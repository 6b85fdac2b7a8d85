"""Large JSON documents read by many tasks.

A document is cut into byte ranges.  A first pass tells for every range, starting inside or outside a string, which brackets it
closes and which it leaves open; carried from range to range this gives the exact place in the document at which each range
starts.  A second pass hands out the elements that begin in a range, reading on until the last of them ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut, ship_code

RANGE_BYTES = 16 << 20
# Bytes looked at before a bracket for its name; a longer name (with its blanks) is no name that is asked for.
NAME_BYTES = 1 << 16
# Ranges are dealt to a task for every ``RANGE_BYTES`` (or as many as a shuffle has), up to this; then a task takes several, one after another.
MOST_TASKS = 20_000

_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*+"|[\[\]{}"]', re.S)
_STRING_END = re.compile(rb'(?:[^"\\]|\\.)*+"', re.S)

Opener = Callable[[str], BinaryIO]


def locate(path: str):
    """``(file system, name)`` of a path, whatever file system its name tells."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def open_file(path: str) -> BinaryIO:
    """A file for reading at any offset."""
    system, name = locate(path)
    return system.open_input_file(name)


def _bytes(f: BinaryIO, start: int, n: int) -> bytes:
    f.seek(start)
    return f.read(n)


def _escaped(buf: bytes, at: int) -> bool:
    k = at
    while k and buf[k - 1] == 0x5C:
        k -= 1
    return (at - k) % 2 == 1


def _before_blanks(buf: bytes, end: int) -> int:
    while end and buf[end - 1] in b" \t\r\n":
        end -= 1
    return end


def _name(buf: bytes, at: int) -> str:
    """The name in front of the bracket at ``at``, '' where it has none."""
    colon = _before_blanks(buf, at)
    if not colon or buf[colon - 1] != 0x3A:
        return ""
    end = _before_blanks(buf, colon - 1) - 1
    start = buf.rfind(b'"', 0, max(0, end))
    while start > 0 and _escaped(buf, start):
        start = buf.rfind(b'"', 0, start)
    return buf[start + 1:end].decode("utf-8", "replace") if start >= 0 else ""


def _enter(buf: bytes, at: int, in_string: bool) -> int | None:
    """Where structure begins: ``at`` itself or behind the string that is open there; None when it does not end here."""
    if not in_string:
        return at
    end = _STRING_END.match(buf, at + 1 if _escaped(buf, at) else at)
    return end.end() if end else None


def brackets(buf: bytes, at: int, in_string: bool) -> tuple[bool, int, list[str]]:
    """``(in_string, closed, opened)`` of ``buf[at:]``: whether it ends in a string, how many brackets of before it closes, and those it leaves open, named."""
    pos = _enter(buf, at, in_string)
    if pos is None:
        return True, 0, []
    closed, opened, ends_inside = 0, [], False
    for t in _TOKEN.finditer(buf, pos):
        c = buf[t.start()]
        if c in b"[{":
            opened.append(t.start())
        elif c in b"]}":
            if opened:
                opened.pop()
            else:
                closed += 1
        elif t.end() == t.start() + 1:  # a quote that nothing here closes
            ends_inside = True
            break
    return ends_inside, closed, [chr(buf[o]) + _name(buf, o) for o in opened]


def _ending(f: BinaryIO, buf: bytes, at: int, base: int) -> bytes:
    """The element that opens at ``buf[at]``, read on as far as it goes; each reading is twice as long."""
    more = 1 << 20
    while True:
        depth = 0
        for t in _TOKEN.finditer(buf, at):
            c = buf[t.start()]
            if c in b"[{":
                depth += 1
            elif c in b"]}":
                depth -= 1
                if depth == 0:
                    return buf[at:t.end()]
            elif t.end() == t.start() + 1:
                break
        fresh = _bytes(f, base + len(buf), more)
        if not fresh:
            return buf[at:]  # an unfinished document
        buf, more = buf + fresh, more * 2


def elements(f: BinaryIO, start: int, end: int, in_string: bool, stack: list[str], within: dict[tuple, str]):
    """``(section, name, text)`` of the elements that begin in ``[start, end)``; ``within`` maps a place to the bracket its elements open with."""
    base = max(0, start - NAME_BYTES)
    buf = _bytes(f, base, end - base)
    pos = _enter(buf, start - base, in_string)
    if pos is None:
        return
    deepest, stack, begun = max(map(len, within)), list(stack), None
    for k in range(1, len(stack)):  # an element that began before
        if within.get(tuple(stack[:k])) == stack[k][0]:
            begun = (k, None)
            break
    for t in _TOKEN.finditer(buf, pos):
        at = t.start()
        c = buf[at]
        if c in b"[{":
            if begun is None:
                if len(stack) <= deepest and within.get(tuple(stack)) == chr(c):
                    begun = (len(stack), at)
                stack.append(chr(c) + (_name(buf, at) if len(stack) <= deepest else ""))
            else:
                stack.append(chr(c))
        elif c in b"]}":
            if stack:
                stack.pop()
            if begun and len(stack) == begun[0]:
                if begun[1] is not None:
                    yield "/".join(stack), _name(buf, begun[1]), buf[begun[1]:t.end()]
                begun = None
        elif t.end() == at + 1:
            break
    if begun and begun[1] is not None:
        yield "/".join(stack[:begun[0]]), _name(buf, begun[1]), _ending(f, buf, begun[1], base)


def _carry(pdf: pd.DataFrame) -> pd.DataFrame:
    """The place at which every range of a document starts, from the summaries of those before it."""
    pdf = pdf.sort_values("start", ignore_index=True)
    inside, stack, at = False, [], []
    for r in pdf.itertuples():
        at.append((inside, list(stack)))
        ends, closed, opened = (r.in_ends, r.in_closed, r.in_opened) if inside else (r.out_ends, r.out_closed, r.out_opened)
        stack = stack[: max(0, len(stack) - closed)] + list(opened)
        inside = ends
    return pd.DataFrame({"path": pdf["path"], "start": pdf["start"], "stop": pdf["stop"], "inside": [a[0] for a in at], "stack": [a[1] for a in at]})


def read_elements(spark: SparkSession, path: str, within: dict[tuple, str], range_bytes: int = RANGE_BYTES, opener: Opener = open_file) -> DataFrame:
    """``(path, section, name, value)``: the elements of JSON documents of any size as text, in no order.

    ``within`` maps the place of a container to the bracket its elements open with: ``("{", "[features")`` to ``"{"`` are the objects
    of the list named features in the outer object.  Elements that are numbers or strings are left out, and so is what is not
    closed correctly in a document that ends early.  Files must not be compressed.  A task holds one range and an element.
    """
    ship_code(spark)
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "length")
    total = files.agg(F.sum(F.ceil(F.col("length") / range_bytes)).alias("ranges"), F.sum("length").alias("bytes")).first()
    # small documents share tasks, so that the driver keeps account of bytes and not of files
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = int(min(total.ranges or 1, max(-(-(total.bytes or 0) // range_bytes), usual), MOST_TASKS))
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"), "length")
    ranges = ranges.select("path", "start", F.least("length", F.col("start") + range_bytes).alias("stop"))

    def summarise(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                with opener(r.path) as f:
                    base = max(0, r.start - NAME_BYTES)
                    buf = _bytes(f, base, r.stop - base)
                out, inn = brackets(buf, r.start - base, False), brackets(buf, r.start - base, True)
                yield pd.DataFrame([(r.path, r.start, r.stop, *out, *inn)], columns=["path", "start", "stop", "out_ends", "out_closed", "out_opened", "in_ends", "in_closed", "in_opened"])

    def hand_out(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                with opener(r.path) as f:
                    rows = []
                    held = 0
                    for section, name, value in elements(f, r.start, r.stop, bool(r.inside), list(r.stack), within):
                        rows.append((r.path, section, name, value.decode("utf-8", "replace")))
                        held += len(value)
                        if held > 1 << 20:
                            yield pd.DataFrame(rows, columns=["path", "section", "name", "value"])
                            rows, held = [], 0
                    yield pd.DataFrame(rows, columns=["path", "section", "name", "value"])

    one = "ends boolean, {0}closed bigint, {0}opened array<string>"
    summary = ranges.repartition(tasks).mapInPandas(summarise, "path string, start bigint, stop bigint, out_" + one.format("out_") + ", in_" + one.format("in_"))
    placed = cut(summary.groupBy("path").applyInPandas(_carry, "path string, start bigint, stop bigint, inside boolean, stack array<string>"))
    return placed.repartition(tasks).mapInPandas(hand_out, "path string, section string, name string, value string")
