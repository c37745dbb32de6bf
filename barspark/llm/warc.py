"""WARC archives with a two-level capture index.

Archives are files of one gzip member per record. The capture index is a set of files of sorted
``key page file offset length`` lines in compressed blocks, where the key is the URL with its
host reversed. A sparse directory holds the first line of each block. A look-up binary-searches
the directory, range-reads one block, binary-searches it, and range-reads the record.

Files go to a folder that all executors share, by any file system that pyarrow opens.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import materialize, new_path, read_table

LINES = 1000
LEVEL = 2
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_PAGE = "-"


def url_key(url: str | None) -> str:
    """The URL with its host reversed and lower-cased, without scheme, user, ``www.`` or blanks."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "://" in text else "//" + text)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return quote(text, safe="/:?&=#%()[],;+@!$*'~")
    host = host.removeprefix("www.")
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "") + (f"#{parts.fragment}" if parts.fragment else "")
    return quote(f"{name}){rest}", safe="/:?&=#%()[],;+@!$*'~")


def record_id(page: int | None) -> str:
    return f"<urn:x-page:{NO_PAGE if page is None else page}>"


def page_of(identifier: str) -> int | None:
    found = identifier.rpartition(":")[2].rstrip(">")
    return None if found == NO_PAGE else int(found)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed: a response with ``payload``, or a revisit of ``refers_to`` without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = quote(url or "", safe="/:?&=#%()[],;+@!$*'~")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[int | None, str, bytes | None, int, str, int | None]:
    """``(page, type, payload, payload size, digest, refers to)`` of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    if kind == "revisit":
        size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
        return page_of(fields["WARC-Record-ID"]), kind, None, size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), page_of(fields["WARC-Refers-To"])
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return page_of(fields["WARC-Record-ID"]), kind, payload, len(payload), digest, None


def _index_line(key: str, page: int | None) -> str:
    return f"{key} {NO_PAGE if page is None else format(page, '+020d')}"


def _pages(pages: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), body.alias("body"))


def write_archives(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)``; returns ``(line, file, offset, length)`` of each.

    Of equal payloads of at least ``least`` bytes the one with the smallest page id is a
    response and the others revisit it. A null ``html`` is an empty payload, a null URL an
    empty one; rows with that smallest id are all responses; a null id is never the smallest,
    and without another id all are responses. An empty table writes no record.
    """
    spark, archive = pages.sparkSession, f"{path}/archive"
    rows = _pages(pages)
    digests = rows.select("page", F.sha1("body").alias("sha1"), F.octet_length("body").cast("long").alias("bytes"))
    digests = materialize(digests, "payload_digests")
    first = digests.where(F.col("bytes") >= least).groupBy("sha1", "bytes").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select("sha1", "bytes", "first"), "first_payloads")
    revisits = digests.join(first, ["sha1", "bytes"]).where("page is null or page <> first").select("page", "sha1", "first").distinct()
    revisits = materialize(revisits, "revisits").withColumn("page", F.coalesce("page", F.lit(-(1 << 63)))).withColumnRenamed("page", "_page")
    named = rows.withColumns({"sha1": F.sha1("body"), "_page": F.coalesce("page", F.lit(-(1 << 63)))})
    named = named.join(revisits, ["_page", "sha1"], "left").select("page", "url", "body", "sha1", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pa.fs.FileSystem.from_uri(archive)
        files.create_dir(folder, recursive=True)
        context = TaskContext.get()
        name = f"{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        at, out = 0, None
        try:
            for batch in batches:
                lines, offsets, lengths = [], [], []
                for page, url, body, sha1, first in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        out = files.open_output_stream(f"{folder}/{name}", compression=None)
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    packed = gzip.compress(record(page, url, body, digest, first), LEVEL, mtime=0)
                    out.write(packed)
                    lines.append(_index_line(url_key(url), page)), offsets.append(at), lengths.append(len(packed))
                    at += len(packed)
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([name] * len(lines), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["line", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return materialize(named.mapInArrow(write, "line string, file string, offset long, length long"), "captures")


def build_index(captures: DataFrame, path: str, lines: int = LINES) -> DataFrame:
    """Write the index files; returns the directory ``(part, first, file, offset, length, lines)``, a row per block."""
    folder_uri = f"{path}/index"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pa.fs.FileSystem.from_uri(folder_uri)
        files.create_dir(folder, recursive=True)
        context = TaskContext.get()
        part = context.partitionId()
        name = f"{part:05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.idx"
        held: list[str] = []
        rows: list[tuple] = []
        at, out = 0, None

        def flush(own: list[str]) -> None:
            nonlocal at, out
            if out is None:
                out = files.open_output_stream(f"{folder}/{name}", compression=None)
            packed = zlib.compress("\n".join(own).encode(), LEVEL)
            out.write(packed)
            rows.append((part, own[0].rsplit("\t", 3)[0], name, at, len(packed), len(own)))
            at += len(packed)

        try:
            for batch in batches:
                held += ["\t".join(map(str, x)) for x in zip(*(c.to_pylist() for c in batch.columns))]
                while len(held) >= lines:
                    flush(held[:lines])
                    del held[:lines]
            if held:
                flush(held)
        finally:
            if out is not None:
                out.close()
        columns = list(zip(*rows)) or [[]] * 6
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "first", "file", "offset", "length", "lines"])

    number = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["line", "file", "offset"]
    dealt = captures.select("line", "file", "offset", "length").repartitionByRange(number, *order).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(write, "part int, first string, file string, offset long, length long, lines long"), "index_directory")


def look_up(requests: DataFrame, directory: DataFrame, path: str) -> DataFrame:
    """``requests(line)``, distinct index lines to find, to ``(line, file, offset, length)`` of every capture with them.

    Only the first line of each index file (at most one per partition of the index) goes to
    all tasks; a task opens the directories of the index files that its requests fall into.
    """
    spark, folder_uri = requests.sparkSession, f"{path}/index"
    bounds = sorted((r["first"], r["part"]) for r in directory.groupBy("part").agg(F.min("first").alias("first")).collect())
    starts, parts = [x[0] for x in bounds], [x[1] for x in bounds]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, to = [], []
            for line in batch.column(0).to_pylist():
                # equal lines of repeated rows may run over several index files
                last = max(bisect_right(starts, line) - 1, 0)
                first = last
                while first > 0 and starts[first] == line:
                    first -= 1
                for k in range(first, last + 1) if parts else ():
                    lines.append(line), to.append(parts[k])
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(lines, pa.string())], ["part", "line"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pa.fs.FileSystem.from_uri(folder_uri)
        part, blocks, opened, name, block_at, lines, keys = None, [], None, None, -1, [], []
        for batch in batches:
            out: list[tuple] = []
            for own, line, table in zip(*(c.to_pylist() for c in batch.columns)):
                if table is not None:
                    part, blocks, block_at = own, sorted((b["first"], b["file"], b["offset"], b["length"]) for b in table), -1
                    firsts = [b[0] for b in blocks]
                    continue
                if own != part:
                    raise ValueError("an index file without a directory")
                k = max(bisect_right(firsts, line) - 1, 0)
                while k > 0 and firsts[k] == line:
                    k -= 1
                while k < len(blocks) and firsts[k] <= line:
                    if k != block_at:
                        if blocks[k][1] != name:
                            name = blocks[k][1]
                            opened = files.open_input_file(f"{folder}/{name}")
                        raw = zlib.decompress(opened.read_at(blocks[k][3], blocks[k][2])).decode()
                        lines = [x.rsplit("\t", 3) for x in raw.split("\n")]
                        keys, block_at = [x[0] for x in lines], k
                    i = bisect_right(keys, line)
                    while i > 0 and keys[i - 1] == line:
                        i -= 1
                        out.append((line, lines[i][1], int(lines[i][2]), int(lines[i][3])))
                    k += 1
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["line", "file", "offset", "length"])

    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = requests.select("line").mapInArrow(route, "part int, line string")
    tables = directory.groupBy("part").agg(F.collect_list(F.struct("first", "file", "offset", "length")).alias("blocks"))
    asked = routed.select("part", "line", F.lit(None).cast(tables.schema["blocks"].dataType).alias("blocks"))
    both = tables.select("part", F.lit("").alias("line"), "blocks").union(asked)
    dealt = both.repartition(number, "part").sortWithinPartitions("part", F.col("blocks").isNull(), "line")
    return dealt.mapInArrow(find, "line string, file string, offset long, length long")


def read_records(found: DataFrame, path: str, payload: bool = True) -> DataFrame:
    """The records at ``found(file, offset, length)``, read by ranges in file order.

    ``(page_id, record_type, payload_bytes, payload_digest, refers_to)`` and, if asked for, the
    ``payload`` (null for a revisit). A response's digest and size are taken from what was read.
    """
    archive = f"{path}/archive"
    schema = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pa.fs.FileSystem.from_uri(archive)
        name, opened = None, None
        for batch in batches:
            out: list[tuple] = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    name, opened = file, files.open_input_file(f"{folder}/{file}")
                page, kind, body, size, digest, to = parse_record(gzip.decompress(opened.read_at(length, offset)))
                out.append((page, kind, size, digest, to, body) if payload else (page, kind, size, digest, to))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())[: 5 + payload]
            columns = list(zip(*out)) or [[]] * len(kinds)
            names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    number = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = F.floor(F.col("offset") / (64 << 20))  # a long file is read by several tasks
    return found.select("file", "offset", "length").repartition(number, "file", split).sortWithinPartitions("file", "offset").mapInArrow(read, schema)


def request_lines(pages: DataFrame) -> DataFrame:
    """The distinct index lines of ``pages(page_id, url)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_index_line(url_key(u), p) for p, u in zip(*(c.to_pylist() for c in batch.columns))], pa.string())], ["line"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    return rows.mapInArrow(run, "line string").distinct()


def archive_and_read(pages: DataFrame, least: int = 0, payload: bool = True) -> DataFrame:
    """Write ``pages`` to archives, index them, and read every capture back through the index.

    Null and empty payloads are records of no bytes, payloads of any length are written and read whole, repeated rows are
    captures of their own, further columns are ignored, and an empty table gives an empty table.
    """
    path = new_path(pages.sparkSession, "warc")
    directory = build_index(write_archives(pages, path, least), path)
    return read_records(look_up(request_lines(pages), directory, path), path, payload)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back through their index."""
    found = archive_and_read(read_table(spark, sf_dir, "pages"), payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), firsts AS (
  SELECT body, min(page_id) AS low FROM rows GROUP BY body
), bits AS (
  SELECT page_id, low, r.body FROM rows r JOIN firsts f ON r.body = f.body
)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum([
      ((instr('0123456789abcdef', substr(sha1(body), 1 + (5 * i + j) // 4, 1)) - 1) >> (3 - (5 * i + j) % 4) & 1) << (4 - j)
      FOR j IN range(5)])::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to
FROM bits
"""
