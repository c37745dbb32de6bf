"""Nearest neighbours by multi-index hashing.

Vectors are put on a sphere, so that the largest inner product is the smallest angle, turned by a
rotation that is learned from a sample, and cut to a code of signs. A code is split into parts and
indexed under each. If two codes differ in at most r bits, some part of m differs in at most r / m
of its own: probing each part's values within that many flips retrieves every code within radius r.
What is retrieved is ranked by the vectors themselves.

The radius follows from a bound that each query has on the score of its last neighbour: first from the
sample, and on large tables from a round of small radius. The closer a query's neighbours are, the
smaller the radius that holds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.llm.common import materialize, read_table, release, whole_runs

TOP, EVERY = 20, 20
BITS = 64
#: Vectors, and components in them, of the sample that the rotation and the first bounds are taken from; it is collected and broadcast.
SAMPLE, SAMPLE_VALUES = 16_384, 1 << 22
#: Radius of the first round, on tables of over ROUNDS_FROM times the sample.
FIRST_RADIUS, ROUNDS_FROM = 16, 8
#: Homes and probes of one value of a part that one comparison takes; more are split.
HOMES, PROBES = 8192, 4096
#: Norms of one class differ by less than a quarter of an octave.
CLASSES = 4
#: What a copy costs, in pairs that are compared.
COPY = 200
#: Sizes of values that are broadcast (24 bytes each); more are joined.
BROADCAST = 1 << 19
#: How far the codes of neighbours are apart at most, in deviations, where no sample tells.
SPREAD = 2.4


def usable(column: str) -> Column:
    """Whether a vector takes part: not null, empty or zero, and all its components finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(column).isNotNull() & ~F.coalesce(F.exists(column, odd), F.lit(True)) & F.coalesce(F.exists(column, lambda x: x != 0), F.lit(False))


def norms(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(1, keepdims=True)
    return np.linalg.norm(x / most, axis=1) * most[:, 0]


def scales(norm: np.ndarray) -> np.ndarray:
    """The class of each norm; its bound is :func:`bound`. A norm of one is just below a bound."""
    return np.ceil(CLASSES * np.log2(norm) - 1e-3).astype(np.int32)


def bound(scale: np.ndarray | int) -> np.ndarray:
    return 2.0 ** ((scale + 2e-3) / CLASSES)


def lifted(x: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Vectors on a sphere of one more dimension: below the bound ``most`` of their norm, or, as queries, on its equator."""
    y = x / (norms(x) if most is None else most)[:, None]
    last = np.zeros(len(x)) if most is None else np.sqrt(np.maximum(0, 1 - (y**2).sum(1)))
    return np.column_stack([y, last])


def _turn(seed: int, n: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def _fitted(v: np.ndarray, turn: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The rotation, from ``turn`` on, that brings ``v`` closest to its signs."""
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return turn


class Codes:
    """Projections by the number of dimensions, learned where the sample has enough vectors, and the spread of neighbours' codes."""

    def __init__(self, sample: dict[int, np.ndarray], top: int = TOP):
        self.top, self.sample, self.known = top, sample, {}
        for dims, x in sample.items():
            if len(x) >= 2 * BITS:
                self.known[dims] = self._learn(x)

    def _learn(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        most = bound(scales(norms(x)))
        y, size = lifted(x, most), x.shape[1] + 1
        if size >= BITS:
            _, axes = np.linalg.eigh(y.T @ y)
            axes = axes[:, ::-1][:, :BITS]
            turn = axes @ _fitted(y @ axes, _turn(size, BITS))
        else:
            turn = np.concatenate([_fitted(y, _turn(size + 1000 * k, size)) for k in range(-(-BITS // size))], axis=1)[:, :BITS]
        base, step = self._signs(y @ turn), max(1, len(x) // 256)
        q = x[::step]
        unit = lifted(q)
        cosine, far = unit @ y.T, np.bitwise_count(self._signs(unit @ turn)[:, None] ^ base[None, :])
        score = (q @ x.T) / norms(q)[:, None]
        score[np.arange(len(q)), np.arange(0, len(x), step)] = -np.inf
        near = np.argpartition(-score, min(self.top, len(x) - 1), axis=1)[:, : self.top]
        p = np.arccos(np.clip(np.take_along_axis(cosine, near, 1), -1, 1)) / np.pi
        z = (np.take_along_axis(far, near, 1) - BITS * p) / np.sqrt(BITS * p * (1 - p) + 0.25)
        return turn, max(1.0, float(np.quantile(z, 0.98)))

    @staticmethod
    def _signs(v: np.ndarray) -> np.ndarray:
        return np.packbits(v > 0, axis=1, bitorder="little").view("<u8")[:, 0]

    def _of(self, dims: int) -> tuple[np.ndarray, float]:
        if dims not in self.known:
            size = dims + 1
            self.known[dims] = np.concatenate([_turn(size + 1000 * k, size) for k in range(-(-BITS // size))], axis=1)[:, :BITS], SPREAD
        return self.known[dims]

    def code(self, y: np.ndarray) -> np.ndarray:
        """Codes of lifted vectors."""
        return self._signs(y @ self._of(y.shape[1] - 1)[0]).view(np.int64)

    def floors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds that the scores of the neighbour after the last and of that twice as far down reach."""
        own, out = self.sample.get(x.shape[1], np.zeros((0, x.shape[1]))), np.full((2, len(x)), -np.inf)
        ranks = [r for r in (self.top, 2 * self.top) if r < len(own)]
        for k in range(0, len(x) if ranks else 0, 256):
            out[: len(ranks), k : k + 256] = -np.partition(-(x[k : k + 256] @ own.T), ranks, axis=1)[:, ranks].T
        return out[0], out[1]

    def radius(self, dims: int, cosine: np.ndarray) -> np.ndarray:
        """The radius that holds neighbours down to ``cosine``; -1 where no vector reaches it."""
        p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
        r = np.ceil(BITS * p + self._of(dims)[1] * np.sqrt(BITS * p * (1 - p) + 0.25))
        return np.where(cosine > 1 + 1e-9, -1, np.where(cosine <= -1, BITS, np.minimum(r, BITS))).astype(np.int32)


def flips(radius: int, sizes: list[int]) -> list[int]:
    """Of each part the flips within which some part of two codes within ``radius`` agrees; -1 for none.

    The first ``radius % m + 1`` of m parts take the quotient, the others one less: were all of
    them exceeded, the codes would differ in more than ``radius`` bits. A part that may differ in all its bits finds every code by itself.
    """
    a, b = divmod(radius, len(sizes))
    found = [a if k <= b else a - 1 for k in range(len(sizes))]
    whole = next((k for k, (f, s) in enumerate(zip(found, sizes)) if f >= s), None)
    return found if whole is None else [sizes[k] if k == whole else -1 for k in range(len(sizes))]


def split(m: int) -> list[int]:
    return [BITS // m + (k < BITS % m) for k in range(m)]


def choose(n: int, asked: dict[int, int]) -> list[int]:
    """The sizes of the parts with the least work for ``asked[radius]`` queries among ``n`` vectors."""

    def work(sizes: list[int]) -> float:
        total = float(n * len(sizes) * COPY)
        for radius, times in asked.items():
            for f, s in zip(flips(radius, sizes), sizes):
                values = sum(comb(s, k) for k in range(min(f, s) + 1))
                total += times * values * (COPY + n / 2**s)
        return total

    return min((split(m) for m in range(2, BITS // 2 + 1)), key=work)


def _masks(size: int, most: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(size), k)], np.int64)


def _vectors(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By number of dimensions: it, the rows that have it, and their vectors."""
    dims = np.diff(lists.offsets.to_numpy())
    flat, begin = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    for d in np.unique(dims).tolist():
        of = np.flatnonzero(dims == d)
        yield d, of, flat[begin[of][:, None] + np.arange(d)]


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


KEYS = ["dims", "scale", "part", "value"]
_COVER = "dims int, scale int, part int, value long, role int, node long, low long, code long, radius int, floor double, vector binary"


def _values(code: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    shift, x = 0, code.view(np.uint64)
    for k, s in enumerate(sizes):
        yield k, (x >> np.uint64(shift) & np.uint64((1 << s) - 1)).astype(np.int64)
        shift += s


def _cover(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of rows ``(role, code, radius)``: a part, row indices, and the values under which these rows are."""
    for batch in batches:
        role, code, radius = (batch.column(c).to_numpy() for c in ("role", "code", "radius"))
        by = [(np.flatnonzero(role == 0), [0] * len(sizes))]
        by += [(np.flatnonzero((role == 1) & (radius == r)), flips(r, sizes)) for r in np.unique(radius[role == 1]).tolist()]
        for rows, most in by:
            for k, value in _values(code[rows], sizes):
                for mask in _masks(sizes[k], most[k]).tolist() if len(rows) else ():
                    yield batch, k, rows, value ^ mask


#: Neighbours that a task holds before it keeps the best of each query only, and still holds after that before it sends them.
HELD, FULL = 200_000, 1_000_000


def best(held: list[tuple[np.ndarray, ...]], top: int) -> tuple[np.ndarray, ...]:
    """Of ``(asker, node, low, score)``, some of them several times, the ``top`` + 1 best of each asker, once each."""
    asker, node, low, score = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((node, low, -score, asker))
    asker, node, low, score = (c[order] for c in (asker, node, low, score))
    once = np.append(True, (asker[1:] != asker[:-1]) | (node[1:] != node[:-1]))
    asker, node, low, score = (c[once] for c in (asker, node, low, score))
    new = np.flatnonzero(np.append(True, asker[1:] != asker[:-1]))
    keep = np.arange(len(asker)) - np.repeat(new, np.diff(np.append(new, len(asker)))) <= top
    return asker[keep], node[keep], low[keep], score[keep]


def compare(batches: Iterator[pa.RecordBatch], dtype: type, top: int) -> Iterator[pa.RecordBatch]:
    """The ``top`` + 1 best of each probe among the homes that are within its radius, of all values that a task gets."""
    held: list[tuple[np.ndarray, ...]] = []
    for table, start in whole_runs(batches, [*KEYS, "i", "j"], 20_000):
        role, node, low, code, radius, floor, scale, dims = (table.column(c).to_numpy() for c in ("role", "node", "low", "code", "radius", "floor", "scale", "dims"))
        vector = table.column("vector").combine_chunks()
        for lo, hi in zip(start.tolist(), np.append(start[1:], table.num_rows).tolist()):
            h = lo + int((role[lo:hi] == 0).sum())
            if h == lo or h == hi:
                continue
            x = np.frombuffer(b"".join(vector.slice(lo, hi - lo).to_pylist()), dtype).reshape(hi - lo, int(dims[lo])).astype(np.float64)
            base = x[: h - lo]
            for first in range(h, hi, 256):
                last = min(first + 256, hi)
                q = x[first - lo : last - lo]
                near = np.bitwise_count((code[first:last, None] ^ code[None, lo:h]).view(np.uint64)) <= radius[first:last, None]
                score = np.where(near, q @ base.T, -np.inf)
                least = floor[first:last].copy()
                open_ = np.flatnonzero(~np.isfinite(least))
                if len(open_) and h - lo > top + 1:
                    least[open_] = -np.partition(-score[open_], top, axis=1)[:, top]
                least -= 1e-9 * norms(q) * bound(int(scale[lo]))
                a, b = np.nonzero(near & (score >= least[:, None]))
                if not len(a):
                    continue
                exact = (q[a] * base[b]).sum(1)
                order = np.lexsort((low[lo + b], -exact, a))
                a, b, exact = a[order], b[order], exact[order]
                new = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                keep = np.arange(len(a)) - np.repeat(new, np.diff(np.append(new, len(a)))) <= top
                held.append((node[first + a[keep]], node[lo + b[keep]], low[lo + b[keep]], exact[keep]))
        if sum(len(x[0]) for x in held) > HELD:
            held = [best(held, top)]
            if len(held[0][0]) > FULL:
                yield _batch(**dict(zip(("asker", "node", "low", "score"), held[0])))
                held = []
    if held:
        yield _batch(**dict(zip(("asker", "node", "low", "score"), best(held, top))))


def _round(nodes: DataFrame, asked: DataFrame, n: int, dtype: type, top: int) -> DataFrame:
    """``asked(asker, dims, scale, radius, code, least, embedding)`` to ``(asker, node, low, score)``, some of them several times."""
    spark = nodes.sparkSession
    sizes = choose(n, {r["radius"]: r["count"] for r in asked.groupBy("radius").count().collect()})  # a row a radius
    homes = nodes.select("dims", "scale", F.lit(0).alias("role"), "node", F.col("ids")[0].alias("low"), "code", F.lit(-1).alias("radius"), F.lit(0.0).alias("floor"), "embedding")
    probes = asked.select("dims", "scale", F.lit(1), "asker", F.lit(0).cast("long"), "code", "radius", F.col("least").alias("floor"), "embedding")
    rows = homes.union(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, at, value in _cover(batches, sizes):
            dims, scale, role = (batch.column(c).to_numpy()[at] for c in ("dims", "scale", "role"))
            keys, times = np.unique(np.stack([dims, scale, value, role]), axis=1, return_counts=True)
            home = keys[3] == 0
            yield _batch(dims=keys[0].astype(np.int32), scale=keys[1].astype(np.int32), part=np.full(len(times), k, np.int32), value=keys[2], homes=np.where(home, times, 0), probes=np.where(home, 0, times))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = np.empty(batch.num_rows, object)
            for _, of, raw in _vectors(batch.column("embedding")):
                packed[of] = [x.tobytes() for x in raw]
            for _, k, at, value in _cover([batch], sizes):
                take = lambda c: batch.column(c).take(pa.array(at))
                yield _batch(dims=take("dims"), scale=take("scale"), part=np.full(len(at), k, np.int32), value=value, role=take("role"), node=take("node"), low=take("low"), code=take("code"), radius=take("radius"), floor=take("floor"), vector=pa.array(packed[at], pa.binary()))

    counted = rows.drop("embedding").mapInArrow(count, "dims int, scale int, part int, value long, homes long, probes long")
    totals = counted.groupBy(*KEYS).agg(F.sum("homes").alias("homes"), F.sum("probes").alias("probes")).where("homes > 0 and probes > 0")
    cells = materialize(totals.select(*KEYS, F.ceil(F.col("homes") / HOMES).cast("int").alias("rows_of"), F.ceil(F.col("probes") / PROBES).cast("int").alias("columns_of")), "cells")
    covered = rows.mapInArrow(cover, _COVER).join(F.broadcast(cells) if cells.count() <= BROADCAST else cells, KEYS)
    part = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    rest = ["role", "node", "low", "code", "radius", "floor", "vector"]
    covered = covered.withColumn("across", F.when(F.col("role") == 0, F.col("columns_of")).otherwise(F.col("rows_of"))).withColumn("k", every("across"))
    home = F.col("role") == 0
    dealt = covered.select(*KEYS, F.when(home, part("rows_of")).otherwise(F.col("k")).alias("i"), F.when(home, F.col("k")).otherwise(part("columns_of")).alias("j"), *rest)
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(number, *KEYS, "i", "j").sortWithinPartitions(*KEYS, "i", "j", "role")
    found = materialize(dealt.mapInArrow(lambda x: compare(x, dtype, top), "asker long, node long, low long, score double"), "neighbours")
    release(cells)
    return found


def nearest(table: DataFrame, queries: Column, top: int = TOP, sample: int = SAMPLE, first: int = ROUNDS_FROM) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``top`` rows of ``table(vec_id, embedding)`` with the largest inner product with each row for which ``queries`` holds.

    A row is not its own neighbour, and neither is another row with its id. Ties go to the smaller id. Null, empty and
    zero vectors, those with a null or non-finite component and rows without an id take no part;
    vectors of different dimensions do not meet. Repeated rows are one. A query with fewer candidates gets all of them. Vectors of any
    length are compared whole; further columns are ignored; an empty table gives an empty table.

    Equal vectors are one node with the ``top`` + 1 least of their ids, which is all that any query can return of them. The sample has at
    most about ``sample`` vectors; every vector is indexed.
    """
    spark = table.sparkSession
    dtype = np.float32 if table.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    kind = "float" if dtype == np.float32 else "double"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).where(usable("embedding") & F.col("vec_id").isNotNull())
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("embedding")), F.lit(1.0)).alias("dims")).first()
    most = max(1, min(sample, int(SAMPLE_VALUES / size["dims"])))
    some = rows.where(F.pmod(F.xxhash64("embedding"), F.lit(max(1, size["n"] // most))) == 0).select("embedding").distinct().limit(2 * most).toArrow()
    by_dims: dict[int, list[np.ndarray]] = {}
    for chunk in some.column(0).chunks:
        for d, _, raw in _vectors(chunk):
            by_dims.setdefault(d, []).append(raw.astype(np.float64))
    model = Codes({d: np.concatenate(x) for d, x in by_dims.items()}, top)
    shared = spark.sparkContext.broadcast(model)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, scale, codes = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for d, of, raw in _vectors(batch.column("embedding")):
                x = raw.astype(np.float64)
                dims[of], scale[of] = d, scales(norms(x))
                codes[of] = shared.value.code(lifted(x, bound(scale[of])))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (dims, scale, codes))], [*batch.schema.names, "dims", "scale", "code"])

    own = Window.partitionBy("embedding", "asks").orderBy("vec_id")
    few = rows.distinct().withColumn("k", F.row_number().over(own)).where(F.col("k") <= top + 1)
    vectors = few.groupBy("embedding").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, top + 1).alias("ids"), F.max("asks").alias("asks"))  # 2 * top + 2 ids at most
    vectors = vectors.select(F.monotonically_increasing_id().alias("node"), "ids", "asks", "embedding")
    nodes = materialize(vectors.mapInArrow(code, f"node long, ids array<long>, asks boolean, embedding array<{kind}>, dims int, scale int, code long"), "vectors")
    classes = nodes.groupBy("dims", "scale").agg(F.count("*").alias("n"))
    n = nodes.count()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, floor, least = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for d, of, raw in _vectors(batch.column("embedding")):
                x = raw.astype(np.float64)
                codes[of] = shared.value.code(lifted(x))
                floor[of], least[of] = shared.value.floors(x)
            yield _batch(asker=batch.column("node"), dims=batch.column("dims"), code=codes, floor=floor, least=least, embedding=batch.column("embedding"))

    def need(least: int, limit: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scale, floor, radius = batch.column("scale").to_numpy(), batch.column("floor").to_numpy(), np.zeros(batch.num_rows, np.int32)
                for d, of, raw in _vectors(batch.column("embedding")):
                    radius[of] = shared.value.radius(d, floor[of] / (norms(raw.astype(np.float64)) * bound(scale[of])))
                at = pa.array(np.flatnonzero(radius > least))
                yield pa.RecordBatch.from_arrays([*batch.take(at).columns, pa.array(np.minimum(radius, limit)[at.to_numpy()])], [*batch.schema.names, "radius"])

        return run

    asking = materialize(nodes.where("asks").select("node", "dims", "embedding").mapInArrow(ask, f"asker long, dims int, code long, floor double, least double, embedding array<{kind}>"), "queries")
    best_of = Window.partitionBy("asker").orderBy(F.desc("score"), "low")
    nothing = F.lit(float("-inf"))

    def leading(found: DataFrame) -> DataFrame:
        once = found.groupBy("asker", "node").agg(F.max("score").alias("score"), F.min("low").alias("low"))
        return once.withColumn("k", F.row_number().over(best_of)).where(F.col("k") <= top + 1)

    best, limits = None, [FIRST_RADIUS, BITS, None] if n > first * max(1, some.num_rows) else [BITS, None]
    for before, limit in zip([-1, *limits], limits):
        if best is not None:
            last = best.where(F.col("k") == top + 1).select("asker", F.col("score").alias("better"))
        if limit is None:  # queries that still lack neighbours look everywhere
            asking = asking.where(F.col("floor") > nothing).join(last, "asker", "left_anti").withColumns({"floor": nothing, "least": nothing})
            if asking.isEmpty():
                break
            before, limit = -1, BITS
        elif best is not None:  # those that have them know a better bound
            asking = asking.join(last, "asker", "left").withColumns({c: F.greatest(c, F.coalesce("better", nothing)) for c in ("floor", "least")}).drop("better")
        layout = asking.join(classes.select("dims", "scale"), "dims").select("asker", "dims", "scale", "code", "floor", "least", "embedding")
        asked = materialize(layout.mapInArrow(need(before, limit), f"asker long, dims int, scale int, code long, floor double, least double, embedding array<{kind}>, radius int"), "asked")
        found = _round(nodes, asked, n, dtype, top)
        best = materialize(leading(found if best is None else found.union(best.select(*found.columns))), "leading")
        release(asked, found)

    named = best.select("asker", "node", "score").join(nodes.select("node", "ids"), "node").select("asker", "score", F.explode("ids").alias("vec_id"))
    row = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("k", F.row_number().over(row)).where(F.col("k") <= top + 1)
    lists = materialize(named.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("found")), "neighbour_lists")
    asker = nodes.where("asks").select(F.col("node").alias("asker"), "embedding")
    each = rows.where("asks").select(F.col("vec_id").alias("query_id"), "embedding").distinct().join(asker, "embedding").select("query_id", "asker")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    out = each.join(lists, "asker").select("query_id", F.posexplode(others).alias("rank", "one"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every twentieth id among all embeddings."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
