"""Best-fit packing by patterns fitted with non-negative least squares.

Only the histogram of piece lengths, at most one number per length, reaches the driver. There,
patterns of a few lengths that fill a sequence are given repeat counts by non-negative least
squares; the counts are rounded down, and the residual lengths go best fit into what is left.
The plan maps ranks within a length to places, so the executors place every piece by its rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.llm.bpe import encoder, public_vocabulary
from barspark.llm.common import materialize, read_table

CAPACITY = 4096
END_ID = 1
#: Steps of length in which patterns are enumerated, and documents in a pattern.
STEPS, DOCUMENTS = 64, 3


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", slices: int = 256) -> DataFrame:
    """``(doc_id, copy, piece, start, length, ids_crc32)``: each row's tokens and the end id, cut only where longer than ``capacity``.

    ``copy`` tells rows of one id apart within their task.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, row = encoder(path, False), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, slices):
                part = batch.slice(lo, slices)
                at, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(e.encode_batch(part.column(0).to_pylist())):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[s : s + 4 * capacity]
                        at.append(i), piece.append(k), start.append(s // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own))
                rows = np.array(at, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1).take(pa.array(rows)), pa.array(rows + row), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "copy", "piece", "start", "length", "ids_crc32"],
                )
                row += part.num_rows

    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), F.col(doc_id).cast("long").alias("doc_id"))
    return rows.mapInArrow(run, "doc_id long, copy long, piece int, start long, length long, ids_crc32 long")


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slope = a.T @ b
    gram, goal = a.T @ a, slope.copy()
    for _ in range(rounds):
        wanted = np.where(free, -np.inf, slope)
        best = int(wanted.argmax())
        if wanted[best] <= 1e-9 * max(1.0, np.abs(goal).max()):
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            s = np.linalg.lstsq(gram[np.ix_(at, at)], goal[at], rcond=None)[0]
            if (s > 1e-12).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 1e-12
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            drop = at[low & (x[at] <= 1e-12 + 0 * at)]
            if not len(drop):
                drop = at[low][:1]
            x[drop], free[drop] = 0, False
            if not free.any():
                break
        slope = goal - gram @ x
    return x


def patterns(steps: int = STEPS, documents: int = DOCUMENTS) -> list[tuple[int, ...]]:
    """Falling tuples of 1 to ``documents`` step counts that add up to ``steps``."""

    def parts(left: int, most: int, n: int) -> Iterator[tuple[int, ...]]:
        if n == 1:
            if 0 < left <= most:
                yield (left,)
            return
        for first in range(min(most, left - n + 1), (left + n - 1) // n - 1, -1):
            for rest in parts(left - first, first, n - 1):
                yield (first, *rest)

    return [p for n in range(1, documents + 1) for p in parts(steps, steps, n)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS, documents: int = DOCUMENTS) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in them, how many like this), using each length as often as the histogram holds it.

    The size of the result depends on ``capacity``, not on the counts.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    step = -(-capacity // steps)
    steps = -(-capacity // step)
    bucket = np.minimum(-(-np.arange(capacity + 1) // step), steps)
    counts = np.bincount(bucket, left, steps + 1)[1:]
    every = patterns(steps, documents)
    a = np.zeros((steps, len(every)))
    for k, p in enumerate(every):
        for s in p:
            a[s - 1, k] += 1
    repeats = np.floor(non_negative_least_squares(a, counts) + 1e-9).astype(np.int64) if counts.any() else np.zeros(len(every), np.int64)
    started: list[tuple[int, tuple[int, ...], int]] = []

    def longest(most: int, least: int, chosen: list[int]) -> int:
        """The longest length from ``least`` to ``most`` of which one is left beside the chosen ones; 0 if none."""
        for x in range(most, least - 1, -1):
            if left[x] > chosen.count(x):
                return x
        return 0

    for k in np.flatnonzero(repeats).tolist():
        n = int(repeats[k])
        while n > 0:
            lengths: list[int] = []
            for i, s in enumerate(every[k]):  # the last one takes what the rounding of lengths to steps has left
                most = capacity - sum(lengths) if i == len(every[k]) - 1 else s * step
                if not (x := longest(min(most, capacity), (s - 1) * step + 1, lengths)):
                    break
                lengths.append(x)
            if len(lengths) < len(every[k]):
                break
            times = min(n, *(int(left[x]) // lengths.count(x) for x in lengths))
            for x in lengths:
                left[x] -= times
            n -= times
            started.append((capacity - sum(lengths), tuple(lengths), times))
    # best fit, longest first: into the started sequence with the least room that suffices, else a new one
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for gap, lengths, times in started:
        room.setdefault(gap, []).append((lengths, times))
    gaps = sorted(room)
    for x in np.flatnonzero(left)[::-1].tolist():
        n = int(left[x])
        while n > 0:
            i = bisect_left(gaps, x)
            if i == len(gaps):
                fit = capacity // x
                whole = n // fit
                for take, times in ((fit, whole), (n - whole * fit, 1)):
                    if take and times:
                        gap = capacity - take * x
                        if gap not in room:
                            room[gap] = []
                            insort(gaps, gap)
                        room[gap].append(((x,) * take, times))
                break
            gap = gaps[i]
            lengths, times = room[gap].pop()
            if not room[gap]:
                del room[gap], gaps[i]
            fit = gap // x
            used = min(times, n // fit) if n >= fit else 0
            take = fit if used else n
            used = used or 1
            n -= used * take
            if times > used:
                if gap not in room:
                    room[gap] = []
                    insort(gaps, gap)
                room[gap].append((lengths, times - used))
            rest = gap - take * x
            if rest not in room:
                room[rest] = []
                insort(gaps, rest)
            room[rest].append((lengths + (x,) * take, used))
    return [x for gap in gaps for x in room[gap]]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with a column ``length`` of 1 to ``capacity``, and ``sequence_id`` and ``offset``.

    Pieces are ranked within their length by a range partition that splits common lengths; the
    driver sees counts by length and partition: at most one row a length and one a partition.
    """
    spark = pieces.sparkSession
    own = pieces.columns  # columns of any name, the added ones too: inside they are c0, c1 and so on
    length_of = own.index("length")
    pieces = pieces.toDF(*[f"c{k}" for k in range(len(own))])
    names = pieces.columns

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            length = batch.column(length_of).to_numpy()
            ranks = np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                ranks[at] = seen.get(x, 0) + np.arange(len(at))
                seen[x] = seen.get(x, 0) + len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(ranks)], [*names, "_part", "_rank"])

    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64(*[F.col(c) for c in names])
    dealt = pieces.withColumn("_spread", spread).repartitionByRange(number, names[length_of], "_spread").sortWithinPartitions(names[length_of], "_spread").drop("_spread")
    ranks = materialize(dealt.mapInArrow(ranked, T.StructType(list(pieces.schema.fields)).add("_part", "integer").add("_rank", "long")), "ranked_pieces")
    counts = sorted((r["length"], r["_part"], r["n"]) for r in ranks.groupBy(F.col(names[length_of]).alias("length"), "_part").agg(F.count("*").alias("n")).collect())
    offsets, total = {}, {}
    for length, part, n in counts:
        offsets[length, part] = total.get(length, 0)
        total[length] = offsets[length, part] + n
    # places of each length: from which rank on, the first sequence and the place in it
    places: dict[int, list[tuple[int, int, int]]] = {}
    taken, sequences = dict.fromkeys(total, 0), 0
    for lengths, times in plan(total, capacity):
        at = 0
        for x in lengths:
            places.setdefault(x, []).append((taken[x], sequences, at))
            taken[x] += times
            at += x
        sequences += times
    tables = {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in places.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, tables = shared.value
        for batch in batches:
            length, part, rank = (batch.column(k).to_numpy() for k in (length_of, len(names), len(names) + 1))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x, p in {*zip(length.tolist(), part.tolist())}:
                at = np.flatnonzero((length == x) & (part == p))
                first, start, place = tables[x]
                r = rank[at] + offsets[x, p]
                k = np.searchsorted(first, r, side="right") - 1
                sequence[at], offset[at] = start[k] + r - first[k], place[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    shared = spark.sparkContext.broadcast((offsets, tables))
    found = ranks.mapInArrow(placed, T.StructType(list(pieces.schema.fields)).add("sequence_id", "long").add("offset", "long"))
    kept = [k for k, c in enumerate(own) if c not in ("sequence_id", "offset")]
    return found.select(*[F.col(names[k]).alias(own[k]) for k in kept], "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece that holds the end id alone. Repeated rows are packed as
    often as they come, a null id stays null; texts of any length are encoded whole; further columns are ignored; an empty table gives an empty table.
    """
    pieces = materialize(token_pieces(docs, path, capacity, text, doc_id), "token_pieces")
    return pack(pieces, capacity).drop("copy")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4,096 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"), public_vocabulary())
