"""Line de-duplication over a range-partitioned stream of line hashes.

Line hashes are range-partitioned and sorted with document and position as secondary keys, so
one pass over a partition sees the first occurrence of each hash before its repeats. A hash may
span partitions: what the first hash of a partition needs from earlier ones is a table of one
row per partition. The result is a compressed bitmap of kept lines per document, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import materialize, read_table, release

LEAST = 10
BLANKS = b" \t\n\r\x0b\x0c"
#: Stands for a null document id: it counts as the largest one.
NO_ID = (1 << 63) - 1


def _own(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``docs`` with the id and text as they are compared, and a key for the row's text."""
    own = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumns({"_id": own, "_text": whole, "_key": F.xxhash64(own, whole)})


def line_hashes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """``(h1, h2, id, key, pos)`` for each line whose key has at least ``least`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            hashes, row, at = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for pos, line in enumerate(text.split(b"\n")):
                    key = line.strip(BLANKS)
                    if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least):
                        hashes.append(digest(key.lower())), row.append(i), at.append(pos)
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            row = np.array(row, np.int64)
            ids, keys = (batch.column(k).to_numpy()[row] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (h[:, 0], h[:, 1], ids, keys)] + [pa.array(at, pa.int32())], ["h1", "h2", "id", "key", "pos"])

    rows = _own(docs, text, doc_id).select("_id", "_key", F.col("_text").cast("binary"))
    return rows.mapInArrow(run, "h1 long, h2 long, id long, key long, pos int")


def dropped_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """``(id, key, pos)`` of each line that an earlier document (by id) already has."""
    spark = docs.sparkSession
    lines = materialize(line_hashes(docs, text, doc_id, least), "line_hashes")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: a line to drop; 1: of the partition's first hash, not decided; 2: the last hash and its first id."""
        last: tuple[int, int, int] | None = None  # hash and first id of the run that the next row may continue
        opening = True  # still in the first run
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, ids = (batch.column(k).to_numpy() for k in range(3))
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            if last is not None:
                new[0] = (h1[0], h2[0]) != last[:2]
            run = np.cumsum(new)
            first = ids[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
            if last is not None:
                first = np.where(run == 0, last[2], first)
            in_first = (run <= (1 if last is None else 0)) if opening else np.zeros(len(ids), bool)
            opening = bool(in_first[-1])
            last = (int(h1[-1]), int(h2[-1]), int(first[-1]))
            kind = np.where(ids != first, 0, np.where(in_first, 1, 3)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kind), *batch.columns], ["kind", *batch.schema.names]).filter(pc.less(pa.array(kind), 3))
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((2, *last, 0, 0), (pa.int32(), *[pa.int64()] * 4, pa.int32()))], ["kind", "h1", "h2", "id", "key", "pos"])

    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "id", "key", "pos"]
    seen = lines.repartitionByRange(number, *order).sortWithinPartitions(*order)
    seen = materialize(seen.mapInArrow(stream, "kind int, h1 long, h2 long, id long, key long, pos int"), "line_stream")
    release(lines)
    ends = seen.where("kind = 2").groupBy("h1", "h2").agg(F.min("id").alias("low"))  # at most a row per partition
    late = seen.where("kind = 1").join(F.broadcast(ends), ["h1", "h2"]).where("low < id")
    return seen.where("kind = 0").select("id", "key", "pos").union(late.select("id", "key", "pos"))


def drop_bitmaps(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """``(id, key, bitmap)`` for each document that loses lines.

    ``bitmap`` is zlib-compressed; bit i (the lowest of each byte first) is 1 if line i goes.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for at in batch.column(2).to_pylist():
                bits = np.zeros(max(at) + 1, np.uint8)
                bits[at] = 1
                maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], ["id", "key", "bitmap"])

    gone = dropped_lines(docs, text, doc_id, least).groupBy("id", "key").agg(F.collect_list("pos").alias("at"))
    return gone.mapInArrow(pack, "id long, key long, bitmap binary")


def deduplicate_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines``, ``n_dropped`` and ``dropped_bitmap`` (null if none go).

    Text splits at ``\\n``; a null or empty text is one empty line. Of a line key (stripped of
    blanks, A-Z lower-cased) of at least ``least`` code points that two documents hold, only the
    lines in the document of smallest id stay. Rows of one id are one document; a null id counts
    as the largest. A text of any length is split whole. An empty table gives an empty table;
    other columns pass through, but for those of the four names, which are replaced.
    """
    added = ["dropped_bitmap", "kept_text", "n_lines", "n_dropped"]
    docs = docs.drop(*(c for c in added if c not in (text, doc_id)))


    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, maps = batch.column(names.index("_text")).to_pylist(), batch.column(names.index("dropped_bitmap")).to_pylist()
            kept, total, gone = [], [], []
            for text, packed in zip(texts, maps):
                if packed is None:
                    kept.append(text), total.append(text.count("\n") + 1), gone.append(0)
                    continue
                lines = text.split("\n")
                bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), bitorder="little")[: len(lines)]
                drop = set(np.flatnonzero(bits).tolist())
                kept.append("\n".join(x for i, x in enumerate(lines) if i not in drop))
                total.append(len(lines)), gone.append(len(drop))
            at = [i for i, n in enumerate(names) if n != "_text"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in at] + [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*(names[i] for i in at), "kept_text", "n_lines", "n_dropped"])

    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = _own(own, f"c{names.index(text)}", f"c{names.index(doc_id)}")
    maps = drop_bitmaps(docs, text, doc_id, least).select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("bitmap").alias("dropped_bitmap"))
    joined = own.join(maps, ["_id", "_key"], "left").drop("_id", "_key")
    schema = joined.drop("_text").schema.add("kept_text", "string").add("n_lines", "long").add("n_dropped", "long")
    out = joined.mapInArrow(cut, schema)
    return out.toDF(*names, *added)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents before and after, with a digest of what stays."""
    found = deduplicate_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT rowid_, doc_id, pos, line, lower_ FROM (
    SELECT rowid_, doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
    FROM (SELECT row_number() OVER () AS rowid_, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
  ), LATERAL (SELECT translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_)
), firsts AS (
  SELECT lower_, min(doc_id) AS low FROM lines WHERE length(lower_) >= 10 GROUP BY lower_ HAVING count(DISTINCT doc_id) >= 2
)
SELECT any_value(l.doc_id) AS doc_id, count(*) AS n_lines,
  count(*) FILTER (low IS NOT NULL AND l.doc_id > low) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (low IS NULL OR l.doc_id <= low), '')) AS kept_sha256
FROM lines l LEFT JOIN firsts f ON l.lower_ = f.lower_ AND length(l.lower_) >= 10
GROUP BY rowid_
"""
