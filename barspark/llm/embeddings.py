"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are turned by a fixed rotation and cut into blocks. A pair whose squared distance
is within the bound has a block in which it is within that block's share of the bound. Each
block is range-joined on a grid over its first two axes; pairs within the block's share are
verified exactly on the whole vectors. A pair counts in the block where it is closest, so each
pair counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import forest, materialize, read_table, release, whole_runs
from barspark.llm.graph import components

COSINE = 0.93
BLOCKS = 8
#: Vectors in one cell, homes or copies, that one comparison takes; a cell with more is split.
HOMES = 2048
SLACK = 1e-9

_rotations: dict[int, np.ndarray] = {}


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation of a space of ``dims`` dimensions."""
    if dims not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
        _rotations[dims] = q * np.sign(np.diag(r))
    return _rotations[dims]


def shares(dims: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The first axis of each block (and the end), and each block's share of the squared distance."""
    edges = np.linspace(0, dims, min(BLOCKS, dims) + 1).astype(int)
    return edges, (2 - 2 * cosine) * np.diff(edges) / dims + SLACK


def _turned(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ rotation(vectors.shape[1])


def _cells(turned: np.ndarray, cosine: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block: the block, row indices, cells, and whether the row is a copy among another cell's homes.

    A row's copies go to the smaller of two cells only.
    """
    edges, share = shares(turned.shape[1], cosine)
    rows = np.arange(len(turned))
    for b, lo in enumerate(edges[:-1].tolist()):
        radius = np.sqrt(share[b])
        side = 2 * radius
        axes = min(2, edges[b + 1] - lo)
        x = turned[:, lo : lo + axes]
        own = np.floor(x / side).astype(np.int64)
        if side * 1022 < 1:  # a cell's number on an axis has 12 bits
            raise ValueError(f"the cosine {cosine} is too close to 1 for cells of {len(edges) - 1} blocks")
        cell = lambda c: ((c[:, 0] + 1024) << 12 | (c[:, 1] + 1024 if axes == 2 else 0)).astype(np.int32)
        home = cell(own)
        yield b, rows, home, np.zeros(len(rows), bool)
        for step in [(i, j) for i in (-1, 0, 1) for j in ((-1, 0, 1) if axes == 2 else (0,)) if i or j]:
            there = own + np.array(step[:axes])
            gap = np.maximum(np.maximum(there * side - x, x - (there + 1) * side), 0)
            other = cell(there)
            at = np.flatnonzero(((gap**2).sum(1) <= share[b]) & (other < home))
            yield b, at, other[at], np.ones(len(at), bool)


def links(vectors: DataFrame, cosine: float = COSINE, homes: int = HOMES) -> DataFrame:
    """``vectors(node, label, n, embedding)``, distinct and valid, to ``(a, b, links)``.

    Rows with ``b`` join the same nodes as all links do; rows without it hold numbers of
    vectors linked to ``a``, each counted with its ``n``.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    dtype = np.float32 if kind == "float" else np.float64
    schema = "label long, dims int, block int, cell int, role int, node long, n long, vector binary"

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            dims = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy().astype(dtype)
            begin = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for d in np.unique(dims).tolist():
                of = np.flatnonzero(dims == d)
                raw = flat[begin[of][:, None] + np.arange(d)]
                packed = np.array([x.tobytes() for x in raw], object)
                turned = _turned(raw.astype(np.float64))
                node, label, n = (batch.column(k).to_numpy()[of] for k in range(3))
                for b, at, cell, copy in _cells(turned, cosine):
                    same = lambda x: pa.array(np.full(len(at), x, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(label[at]), same(d), same(b), pa.array(cell), pa.array(copy.astype(np.int32)), pa.array(node[at]), pa.array(n[at]), pa.array(packed[at], pa.binary())],
                        ["label", "dims", "block", "cell", "role", "node", "n", "vector"],
                    )

    keys = ["label", "dims", "block", "cell"]
    rows = vectors.select("node", F.col("label").cast("long"), F.col("n").cast("long"), "embedding").mapInArrow(cover, schema)
    parts = lambda n: F.ceil(n / homes).cast("int")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size"), F.count_if(F.col("role") == 0).alias("own")).where((F.col("size") > homes) & (F.col("own") > 0))
    crowded = materialize(sizes.select(*keys, parts(F.col("own")).alias("rows_of"), parts(F.col("size")).alias("columns_of")), "crowded")
    many = crowded.count()
    rest = ["role", "node", "n", "vector"]
    if many:
        rows = rows.join(F.broadcast(crowded) if many <= 10_000 else crowded, keys, "left")
        part = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        hot = rows.where("rows_of is not null")
        rows = (
            rows.where("rows_of is null").select(*keys, F.lit(-1).alias("i"), F.lit(-1).alias("j"), *rest)
            .union(hot.where("role = 0").select(*keys, part("rows_of"), every("columns_of"), *rest))
            .union(hot.select(*keys, every("rows_of"), part("columns_of"), F.when(F.col("role") == 0, 2).otherwise(1), "node", "n", "vector"))
        )
    else:
        rows = rows.select(*keys, F.lit(-1).alias("i"), F.lit(-1).alias("j"), *rest)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in whole_runs(batches, [*keys, "i", "j"], 20_000):
            end = np.append(start[1:], table.num_rows)
            node, n, dims, block, split, role = (table.column(c).to_numpy() for c in ("node", "n", "dims", "block", "i", "role"))
            vector = table.column("vector").combine_chunks()
            found, counts = [np.zeros((2, 0), np.int64)], []
            for lo, hi in zip(start.tolist(), end.tolist()):
                h = int((role[lo:hi] == 0).sum())
                if not h or hi - lo < 2:
                    continue
                d, b = int(dims[lo]), int(block[lo])
                edges, share = shares(d, cosine)
                raw = np.frombuffer(b"".join(vector.slice(lo, hi - lo).to_pylist()), dtype).reshape(-1, d).astype(np.float64)
                turned = _turned(raw)
                own = turned[:, edges[b] : edges[b + 1]]
                square = (own**2).sum(1)
                norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
                for first in range(0, h, 512):
                    last = min(first + 512, h)
                    near = square[first:last, None] + square[None, :] - 2 * own[first:last] @ own.T <= share[b] + SLACK
                    p, q = np.nonzero(near)
                    p += first
                    if split[lo] < 0:
                        keep = p < q
                    else:  # homes of a split cell meet each other as copies, of which one of two counts
                        keep = (q >= h) & ((role[lo + q] == 1) | (node[lo + p] < node[lo + q]))
                    p, q = p[keep], q[keep]
                    for cut in range(0, len(p), 20_000):
                        x, y = p[cut : cut + 20_000], q[cut : cut + 20_000]
                        ok = np.einsum("ij,ij->i", raw[x], raw[y]) / (norm[x] * norm[y]) >= cosine
                        x, y = x[ok], y[ok]
                        apart = np.add.reduceat((turned[x] - turned[y]) ** 2, edges[:-1], axis=1) if len(x) else np.zeros((0, 1))
                        ok = (apart / share).argmin(1) == b if len(x) else np.zeros(0, bool)
                        x, y = x[ok] + lo, y[ok] + lo
                        if len(x):
                            found.append(np.stack(forest(node[x], node[y])))
                            counts += [(node[x], n[y]), (node[y], n[x])]
            u, v = np.concatenate(found, axis=1)
            if len(u):
                u, v = forest(u, v)
            who, k = (np.concatenate(c) for c in zip(*counts)) if counts else (np.zeros(0, np.int64),) * 2
            ids, inverse = np.unique(who, return_inverse=True)
            total = np.bincount(inverse, k, len(ids)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, ids])), pa.array([*v.tolist(), *[None] * len(ids)], pa.int64()), pa.array(np.concatenate([np.zeros(len(u), np.int64), total]))], ["a", "b", "links"])

    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(number, *keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "role")
    found = materialize(dealt.mapInArrow(compare, "a long, b long, links long"), "vector_links")
    release(crowded)
    return found


def near_duplicates(table: DataFrame, cosine: float = COSINE, homes: int = HOMES) -> DataFrame:
    """One row ``(vec_id, n_links, component_id, kept)`` per row of ``table(vec_id, label, embedding)``.

    Rows link if labels are equal and not null, dimensions are equal and the cosine is at
    least ``cosine``. Null, empty and zero vectors and those with a null or non-finite
    component link with nothing, and are their own component. Equal vectors are one node,
    and link with each other. A null ``vec_id`` is never the smallest, and is not kept. Vectors of any length are
    compared whole, further columns are ignored, and an empty table gives an empty table.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fit = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", odd), F.lit(True)) & F.exists("embedding", lambda x: x != 0)
    distinct = rows.where(fit).groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    vectors = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = links(vectors.select("node", "label", "n", "embedding"), cosine, homes)
    rooted = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    whole = vectors.join(rooted, "node", "left").join(counts, "node", "left")
    whole = materialize(whole.select("label", "embedding", "low", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "rooted")
    release(vectors, found)
    least = materialize(whole.groupBy("root").agg(F.min("low").alias("component_id")), "component_ids")
    per_vector = materialize(whole.join(least, "root").select("label", "embedding", "n_links", "component_id"), "per_vector")
    release(whole, least)
    joined = rows.withColumn("_fit", fit).join(per_vector.withColumn("_fit", F.lit(True)), ["label", "embedding", "_fit"], "left")
    own = F.when(F.col("_fit"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE fit AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), linked AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN linked l ON r.y = l.x
)
SELECT v.vec_id, (SELECT count(*) FROM linked l WHERE l.x = v.vec_id) AS n_links,
  min(r.y) AS component_id, v.vec_id = min(r.y) AS kept
FROM embeddings v JOIN reach r ON r.x = v.vec_id GROUP BY v.vec_id
"""
