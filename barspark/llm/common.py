"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a local session gets a temporary folder and a cluster a folder in
    the warehouse, which is shared too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="checkpoints-"))
        return _own_folder[0]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._written_to = path
    return read


def release(*written: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing will read again."""
    for df in written:
        hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(df._written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_held: dict[object, object] = {}


def worker_state(token: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between its batches, made if another operator's is kept: the stages of a pipeline use the same workers, and their memories do not add up."""
    if token not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held[token] = make()
    return _held[token]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) as stars: every node but the least of its component, and that least node."""
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Regroup sorted batches into tables of whole runs of equal ``keys``.

    Yields a table of at least ``least`` rows (but for the last) and the start of each run
    in it. A run longer than the table is kept together, so runs must be of bounded length.
    """
    held: list[pa.Table] = []
    rows = 0

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
        if rows >= least:
            table = pa.concat_tables(held).combine_chunks()
            at = starts(table)
            if len(at) > 1:
                yield table.slice(0, at[-1]), at[:-1]
            held = [table.slice(at[-1])]
            rows = held[0].num_rows
            least = max(least, 2 * rows)
    if rows:
        table = pa.concat_tables(held).combine_chunks()
        yield table, starts(table)


def later_pairs(first: np.ndarray, end: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with i in ``first`` and i < j < its ``end``, about ``most`` at a time."""
    counts = end - first - 1
    first, counts = first[counts > 0], counts[counts > 0]
    if not len(first):
        return
    cut = np.searchsorted(np.cumsum(counts), np.arange(most, counts.sum() + most, most))
    lo = 0
    for hi in np.unique(np.minimum(cut + 1, len(first))):
        if hi <= lo:
            continue
        n = counts[lo:hi]
        i = np.repeat(first[lo:hi], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        yield i, j
        lo = hi
