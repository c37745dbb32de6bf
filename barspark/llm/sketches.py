"""Similar texts by sketches of their word shingles, for similarities that few bits of a fingerprint cannot hold.

A sketch has the low byte of the least value of each of 256 permutations of a text's shingles: two texts
agree in as many bytes as their shingles overlap. Texts meet where the least values of four permutations in a row are equal, in one of
six such bands, and link if their whole sketches agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import forest, materialize, release, whole_runs

WORDS, SIMILARITY, SEED = 5, 0.8, 42
PERMUTATIONS, BANDS, ROWS = 256, 6, 4
#: What sampling may take off the agreement of two sketches.
ALLOWANCE = 0.04
#: Texts of one band that one comparison takes; more are split.
HOMES = 4096
_FACTOR, _ADDEND = (np.random.default_rng(SEED + k).integers(0, 1 << 63, PERMUTATIONS, np.uint64) for k in (0, 1))
_FACTOR = _FACTOR * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of the lower-cased word shingles; of the whole sequence if it is shorter than one."""
    found = text.lower().split()
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)] if found else [], np.uint64)
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    start = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    ends = (start + size)[words - 1 :].tolist()
    return np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(start.tolist(), ends)), np.uint64, len(ends))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Keys of the bands, and the sketch."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[lo : lo + 512, None] * _FACTOR + _ADDEND).min(0))
    mixed = least ^ least >> np.uint64(29)
    keys = [xxhash.xxh64_intdigest(mixed[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64), (least >> np.uint64(40)).astype(np.uint8).tobytes()


def linked(signs: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same rows of ``signs`` as all pairs that agree in at least ``least`` of their bytes.

    From each row that has been joined, only rows outside its component are looked at: of a group of copies
    each is compared about once.
    """
    n, u, v = len(signs), [], []
    outside = np.arange(n)
    while len(outside) > 1:
        front, outside = [int(outside[0])], outside[1:]
        while front and len(outside):
            at = front.pop()
            near = np.concatenate([(signs[outside[k : k + 4096]] == signs[at]).mean(1) >= least for k in range(0, len(outside), 4096)])
            new, outside = outside[near], outside[~near]
            u += [at] * len(new)
            v += new.tolist()
            front += new.tolist()
    return np.array(u, np.int64), np.array(v, np.int64)


def similar(texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, homes: int = HOMES) -> DataFrame:
    """``texts(node, text)``, with a text a node, to links ``(a, b)`` that join nodes of at least about ``similarity``, the Jaccard index of their word shingles.

    Null and empty texts and those without a word link with nothing; texts of any length are read whole. Of repeated
    nodes any row may speak. A band with over ``homes`` texts is split into parts, and each pair of parts is compared.
    """
    number = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    agree = similarity - ALLOWANCE
    agree += (1 - agree) / 256  # bytes also agree by chance

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                keys, nodes, signs = [], [], []
                for node, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    hashes = shingle_hashes(text or b"", words)
                    if len(hashes):
                        own, sign = sketch(hashes)
                        keys.append(own), nodes.append(node), signs.append(sign)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([k.tolist() for k in keys], pa.list_(pa.int64())), pa.array(signs, pa.binary())], ["node", "keys", "sign"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in whole_runs(batches, ["key", "i", "j"], 20_000):
            node, sign = table.column("node").to_numpy(), table.column("sign").combine_chunks()
            found = [np.zeros((2, 0), np.int64)]
            for lo, hi in zip(start.tolist(), np.append(start[1:], len(node)).tolist()):
                if hi - lo > 1:
                    own, first = np.unique(node[lo:hi], return_index=True)
                    signs = np.frombuffer(b"".join(sign.take(pa.array(first + lo)).to_pylist()), np.uint8).reshape(-1, PERMUTATIONS)
                    u, v = linked(signs, agree)
                    found.append(np.stack([own[u], own[v]]))
            u, v = np.concatenate(found, axis=1)
            if len(u):
                u, v = forest(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    rows = texts.select(F.col("node").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(signed, "node long, keys array<long>, sign binary")
    rows = materialize(rows, "sketches")
    each = rows.select("node", F.explode("keys").alias("key"))
    sizes = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(sizes.select("key", F.ceil(F.col("n") / homes).cast("int").alias("parts")), "shared_bands")
    met = each.join(shared, "key").withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = met.select("node", "key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))
    # a node comes with its sketch only to the bands that it shares, and only once to each cell
    dealt = cells.join(rows.select("node", "sign").dropDuplicates(["node"]), "node").repartition(number, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = materialize(dealt.select("key", "i", "j", "node", "sign").mapInArrow(compare, "a long, b long").where("a <> b"), "similar")
    release(rows, shared)
    return links
