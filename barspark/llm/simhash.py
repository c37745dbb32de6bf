"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into three blocks. Each block is covered by the binary Golay code of
length 23: every word lies within 3 bits of one codeword, its anchor. Of fingerprints that
differ in at most 3 bits, two blocks differ in at most one bit each, and then either's
anchors of those two blocks lie within 3 + 1 bits of the other's blocks. So a fingerprint
has its home at its own pair of anchors and is copied to every pair of anchors within that
radius; comparing homes with copies at each anchor pair finds every link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import forest, later_pairs, materialize, read_table, release, whole_runs
from barspark.llm.graph import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Width of each block of the fingerprint; zero bits fill it up to the length of the code.
BLOCKS = (22, 21, 21)
#: Fingerprints at one anchor pair, homes or copies, that one comparison takes; more are split.
HOMES = 4096
#: Generator polynomial of the Golay code of length 23 (a fixed value).
GOLAY = 0b110001110101


def fingerprint(text: bytes | None, words: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of lower-cased word shingles; 0 where there is no word."""
    found = text.lower().split() if text else []
    if not found:
        return 0
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    if n == 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, found), np.int64, len(found))
        start = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
        end = (start + size)[words - 1 :]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(start.tolist(), end.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        part = hashes[lo : lo + 65536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` of each row and ``fp``, the fingerprint of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([fingerprint(x, words) for x in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], got], [*names, "fp"])

    rows = docs.select(F.col(text).cast("string").cast("binary").alias("_text"), *keep)
    names = [f.name for f in rows.schema.fields[1:]]
    schema = rows.drop("_text").schema.add("fp", "long")
    return rows.mapInArrow(run, schema)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The remainder of the high 12 bits, and by remainder the least error and the errors of weight 4."""
    high = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        high = np.where(high >> bit & 1, high ^ (GOLAY << (bit - 11)), high)
    remainder = lambda w: high[w >> 11] ^ (w & 0x7FF)
    least, four = np.zeros(2048, np.int64), [[] for _ in range(2048)]
    for weight in (1, 2, 3, 4):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)
        if weight < 4:
            least[remainder(errors)] = errors
        else:
            for r, e in zip(remainder(errors).tolist(), errors.tolist()):
                four[r].append(e)
    most = max(map(len, four))
    return high, least, np.array([x + [0] * (most - len(x)) for x in four], np.int64)


_cache: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _anchors(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchor of each block (as its 12 leading bits), those within one bit more, and which of these exist."""
    if not _cache:
        _cache.append(_tables())
    high, least, four = _cache[0]
    r = high[block >> 11] ^ (block & 0x7FF)
    more = four[r]
    return (block ^ least[r]) >> 11, (block[:, None] ^ more) >> 11, more != 0


def covering(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (anchor pair, is a copy, index into ``fp``): a home per pair of blocks, and copies.

    Of two different homes the one at the smaller pair receives the copy of the other.
    """
    x, shift, blocks = fp.view(np.uint64), 0, []
    for width in BLOCKS:
        blocks.append(_anchors((x >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)))
        shift += width
    keys, copies, rows = [], [], []
    n = np.arange(len(fp))
    for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2)):
        home = k << 24 | blocks[i][0] << 12 | blocks[j][0]
        keys.append(home), copies.append(np.zeros(len(fp), bool)), rows.append(n)
        one = [np.column_stack([b[0], b[1]]) for b in (blocks[i], blocks[j])]
        there = [np.column_stack([np.ones(len(fp), bool), b[2]]) for b in (blocks[i], blocks[j])]
        for p in range(one[0].shape[1]):
            for q in range(one[1].shape[1]):
                key = k << 24 | one[0][:, p] << 12 | one[1][:, q]
                at = np.flatnonzero(there[0][:, p] & there[1][:, q] & (key < home))
                keys.append(key[at]), copies.append(np.ones(len(at), bool)), rows.append(at)
    return np.concatenate(keys), np.concatenate(copies), np.concatenate(rows)


def links(prints: DataFrame, homes: int = HOMES) -> DataFrame:
    """``prints(fp)``, distinct, to ``(a, b)``: links that join the same fingerprints as all pairs do.

    An anchor pair with over ``homes`` homes and copies is split into a grid of cells, each with a
    part of the homes and a part of the whole.
    """
    spark = prints.sparkSession

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for lo in range(0, len(fp), 20_000):
                part = fp[lo : lo + 20_000]
                key, copy, row = covering(part)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(copy), pa.array(part[row])], ["key", "copy", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in whole_runs(batches, ["key", "i", "j"], 100_000):
            fp, home = table.column("fp").to_numpy(), ~table.column("copy").to_numpy()
            end = np.repeat(np.append(start[1:], len(fp)), np.diff(np.append(start, len(fp))))
            at = np.flatnonzero(home)
            found = [np.zeros((2, 0), np.int64)]
            for a, b in later_pairs(at, end[at], 2_000_000):
                near = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= DISTANCE
                if near.any():
                    found.append(np.stack(forest(fp[a[near]], fp[b[near]])))
            u, v = np.concatenate(found, axis=1)
            if len(u):
                u, v = forest(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    rows = prints.select("fp").mapInArrow(cover, "key int, copy boolean, fp long")
    parts = lambda n: F.ceil(n / homes).cast("int")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("copy")).alias("own")).where((F.col("n") > homes) & (F.col("own") > 0))
    crowded = materialize(sizes.select("key", parts(F.col("own")).alias("rows_of"), parts(F.col("n")).alias("columns_of")), "crowded")
    n = crowded.count()
    if n:
        rows = rows.join(F.broadcast(crowded) if n <= 10_000 else crowded, "key", "left")
        part = lambda of: F.pmod(F.xxhash64("fp"), F.col(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        hot = rows.where("rows_of is not null")
        split = (
            hot.where("not copy").select("key", "copy", "fp", part("rows_of").alias("i"), every("columns_of").alias("j"))
            .union(hot.select("key", F.lit(True), "fp", every("rows_of"), part("columns_of")))
        )
        rows = rows.where("rows_of is null").select("key", "copy", "fp", F.lit(0).alias("i"), F.lit(0).alias("j")).union(split)
    else:
        rows = rows.select("key", "copy", "fp", F.lit(0).alias("i"), F.lit(0).alias("j"))
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(number, "key", "i", "j").sortWithinPartitions("key", "i", "j", "copy")
    return dealt.mapInArrow(compare, "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs``, with its columns ``keep`` and ``root``, the same of all of a component, if any are named; extra columns are ignored.

    Null and empty texts and those without a word have fingerprint zero and link like any
    other; a text of any length is hashed whole. Repeated rows come out as often as they go in. A null id is never the smallest:
    ``component_id`` is null only where all ids of a component are null. An empty table
    gives an empty table.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *keep)
    rows = materialize(fingerprints(own, keep=("doc_id", *keep), words=words), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "prints")
    linked = components(links(prints))
    rooted = prints.join(linked, prints.fp == linked.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    release(prints)
    least = materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "component_ids")
    by_print = materialize(rooted.join(least, "root").select("fp", "component_id", *(["root"] if keep else [])), "by_print")
    release(rooted, least)
    return rows.join(by_print, "fp").select("doc_id", "fp", "component_id", *(["root", *keep] if keep else []))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
