"""WARC archives: written by Spark's text writer, read by a Python data source.

The reader plans file partitions, takes predicates on the record type and on headers, parses a record's headers first and
seeks past payloads that nobody asked for.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith
from pyspark.sql.types import StructType

from ..session import scratch_path

VERSION = "WARC/1.1"
# Payloads below this size are stored again; it is not worth a reference.
REVISIT_BYTES = 100
# Parts in which the pages of one digest meet it.
DIGEST_PARTS = 32
# Bytes of files in one partition, and of payloads in one batch.
PARTITION_BYTES, BATCH_BYTES, BATCH_ROWS = 64 << 20, 8 << 20, 4096

#: Column -> header; each can be asked for in a predicate.
HEADER_COLUMNS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, headers map<string,string>, content_length bigint, payload binary"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.types = [f.name for f in schema], schema
        self.path = options["path"]
        self.target = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[tuple[str, tuple[str, ...] | None, str]] = []

    def pushFilters(self, filters: list[Filter]):
        """Keep what a header alone decides; the rest goes back to Spark."""
        for f in filters:
            header = HEADER_COLUMNS.get(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if header and isinstance(f, EqualTo):
                self.tests.append((header, (f.value,), ""))
            elif header and isinstance(f, In):
                self.tests.append((header, tuple(f.value), ""))
            elif header and isinstance(f, StringStartsWith):
                self.tests.append((header, None, f.value))
            elif header and isinstance(f, IsNotNull):
                self.tests.append((header, None, ""))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Whole files, small ones together: a payload may hold anything, so only a file's start is surely a record's."""
        from pyarrow import fs

        store, root = _file_system(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        out, held = [], self.target
        for f in sorted(found, key=lambda f: f.path):
            if f.type != fs.FileType.File or f.base_name[0] in "._" or not f.size:
                continue
            if held + f.size > self.target:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(f.path)
            held += f.size
        return out

    def wanted(self, headers: dict[str, str]) -> bool:
        for header, values, start in self.tests:
            got = headers.get(header)
            if got is None or (values is not None and got not in values) or not got.startswith(start):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _file_system(self.path)
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.types)
        rows: list[dict] = []
        size = 0
        for path in partition.paths if partition else []:  # no file, no partition
            with store.open_input_file(path) as raw:
                stream = gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
                for headers, length in records(stream):
                    after = stream.tell() + length
                    if self.wanted(headers):
                        row = {name: headers.get(h) for name, h in HEADER_COLUMNS.items()} | {"headers": list(headers.items()), "content_length": length}
                        if "payload" in self.columns:
                            row["payload"] = stream.read(length)
                            size += length
                        rows.append(row)
                    stream.seek(after)
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def records(stream) -> Iterator[tuple[dict[str, str], int]]:
    """Headers (lower-case names) and payload length of each record; the caller leaves the stream behind the payload."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers: dict[str, str] = {}
        name = ""
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a record's headers end with the file")
            text = line.decode("utf-8").strip("\r\n")
            if text[:1] in (" ", "\t") and name:
                headers[name] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            name = name.strip().lower()
            headers[name] = value.strip()
        yield headers, int(headers["content-length"])


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; leave ``payload`` out of the schema to skip all payloads."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(SCHEMA if payload else SCHEMA.replace(", payload binary", "")).load(path)


def _header(name: str, value: Column) -> Column:
    """A header line, none for a null; line breaks in a value would end it."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def with_revisits(pages: DataFrame, key: str = "page_id", body: str = "html", at_least: int = REVISIT_BYTES) -> DataFrame:
    """Add ``payload_digest``, ``payload_bytes``, ``record_type`` and ``refers_to``.

    Only digests that occur again are joined, one row for each part in which their pages are dealt; small payloads have
    nothing to meet and are dealt by key.
    """
    text = F.coalesce(F.col(body), F.lit(""))
    marked = pages.withColumns({body: text, "payload_digest": F.sha2(text.cast("binary"), 256), "payload_bytes": F.octet_length(text).cast("bigint")})
    again = (marked.filter(F.col("payload_bytes") >= at_least).groupBy("payload_digest").agg(F.min(key).alias("__first"), F.count(F.lit(1)).alias("__n"))
             .filter("__n > 1").select(F.col("payload_digest").alias("__digest"), "__first", F.explode(F.sequence(F.lit(0), F.lit(DIGEST_PARTS - 1))).alias("__part")))
    dealt = F.xxhash64(F.col(key))
    meets = F.when(F.col("payload_bytes") >= at_least, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), dealt.cast("string")))
    marked = marked.withColumns({"__meets": meets, "__deal": F.pmod(dealt, F.lit(DIGEST_PARTS)).cast("int")})
    revisit = F.coalesce(F.col(key) != F.col("__first"), F.col("__first").isNotNull())
    return (marked.join(again, (F.col("__meets") == F.col("__digest")) & (F.col("__deal") == F.col("__part")), "left")
            .withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("__first"))})
            .drop("__digest", "__first", "__part", "__meets", "__deal"))


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html", date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """A record per row of ``with_revisits``: a revisit has no block and names the response.

    Payloads are UTF-8 text, so records are text rows; the line separator is each record's last byte.  Compressed files take a third of
    the disk; in files written with ``compression="none"`` a reader seeks past payloads instead of inflating them.
    """
    def urn(k: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), k.cast("string"), F.lit(">"))

    block = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col(body))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), _header("WARC-Type", F.col("record_type")), _header("WARC-Record-ID", F.coalesce(urn(F.col(key)), F.lit("<urn:page:none>"))),
        _header("WARC-Date", F.lit(date)), _header("WARC-Target-URI", F.col(url)), _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _header("WARC-Refers-To", urn(F.col("refers_to"))),
        _header("WARC-Profile", F.when(F.col("record_type") == "revisit", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("X-Page-Id", F.col(key).cast("string")), _header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        _header("Content-Type", F.lit("text/html; charset=utf-8")), _header("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    pages.select(F.concat(head, block, F.lit("\r\n\r")).alias("value")).write.option("lineSep", "\n").option("compression", compression).text(path)


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """``(key, payload_bytes, payload_digest, record_type, refers_to)`` as read back from written archives.

    Digest and size of a response are taken from the payload read, those of a revisit from its headers, without any payload.
    A null html is an empty payload, a null url has no header.  Of equal payloads every row with the least key is a response, so
    a repeated row is one as well; a row with a null key revisits the others, and is a response where no key is known.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(with_revisits(pages.select(key, url, body), key, body), path, key, url, body)
    kind = pages.schema[key].dataType
    page_id = F.col("headers")["x-page-id"].cast(kind).alias(key)
    full = read_warc(spark, path).filter("record_type = 'response'")
    responses = full.select(page_id, F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    bare = read_warc(spark, path, payload=False).filter("record_type = 'revisit'")
    revisits = bare.select(page_id, F.col("headers")["x-payload-length"].cast("bigint").alias("payload_bytes"), F.regexp_extract("payload_digest", "^sha256:(.*)$", 1).alias("payload_digest"),
                           "record_type", F.regexp_extract("refers_to", "^<urn:page:(.*)>$", 1).cast(kind).alias("refers_to"))
    return responses.unionByName(revisits)
