"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size. Shards take
turns, each claiming the first free slot of its order, until the table is full. A key's slot is
its hash modulo the size, so placing a row is one lookup in a broadcast table of fixed size, and
adding or removing a shard moves few slots of the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import new_path, read_table

SLOTS = 65537
SHARDS = tuple(f"shard-{i:04d}" for i in range(256))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The index of the shard of each slot. ``slots`` is prime and at least the number of shards.

    No shards, repeated names, or a size that is not prime raise ``ValueError``. Shards differ
    by at most one in the slots they hold, whatever their names.
    """
    if not shards or len(set(shards)) < len(shards) or slots < len(shards):
        raise ValueError("shards must be distinct, and 1 to the number of slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    start = [_number(f"start:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table = [-1] * slots
    at, left = list(start), slots
    while left:
        for k, step in enumerate(skip):
            slot = at[k]
            while table[slot] >= 0:
                slot = (slot + step) % slots
            table[slot] = k
            at[k] = (slot + step) % slots
            left -= 1
            if not left:
                break
    return np.array(table, np.int32)


def _placed(df: DataFrame, key: str, shards: Sequence[str], slots: int) -> DataFrame:
    """``df`` as ``c0``, ``c1`` and so on, with ``slot`` and ``shard``, so that no column of it can clash."""
    spark = df.sparkSession
    owner = lookup_table(shards, slots)
    table = spark.createDataFrame(pd.DataFrame({"slot": np.arange(slots, dtype=np.int32), "shard": np.array(shards, object)[owner]}))
    table = table.select(F.col("slot").cast("int").alias("slot"), "shard")
    rows = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    hashed = rows.withColumn("slot", F.pmod(F.xxhash64(F.col(f"c{df.columns.index(key)}")), F.lit(slots)).cast("int"))
    return hashed.join(F.broadcast(table), "slot").select(*rows.columns, "slot", "shard")


def _kept(df: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """``df`` without the columns that ``slot`` and ``shard`` replace, and the names of all columns of the result."""
    base = df.drop(*(c for c in ("slot", "shard") if c != key))
    return base, [*base.columns, *(("slot", "shard") if key not in ("slot", "shard") else ("_slot", "_shard"))]


def place(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``.

    Equal keys go to one shard. A null key goes to the slot of the hash of no value; texts of any length and repeated
    rows stay; columns of ``df`` named ``slot`` or ``shard`` are replaced, but for the key, beside which the new ones are
    ``_slot`` and ``_shard``; columns of any other name pass through. An empty table gives an empty table. The broadcast
    table has ``slots`` rows whatever the size of ``df``.
    """
    base, names = _kept(df, key)
    return _placed(base, key, shards, slots).toDF(*names)


def write_shards(df: DataFrame, key: str, path: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Write ``df`` as Parquet under ``path``, a folder a shard, and return what was written, with the columns of :func:`place`.

    A shard with more than an eighth of a task's even part of the rows is dealt over tasks in such
    parts, so that a key of a third of all rows fills many files of its shard. Columns pass
    through whatever their names and types; in the files they are ``c0``, ``c1`` and so on, in the order of ``df``. An empty table writes no shard.
    """
    base, names = _kept(df, key)
    placed = _placed(base, key, shards, slots)
    spark, number = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = {r[0]: r[1] for r in placed.groupBy("shard").count().collect()}  # a row a shard at most
    even = max(1, sum(sizes.values()) // (8 * number))  # small parts, so that hashing deals them evenly
    parts = spark.createDataFrame([(k, -(-n // even)) for k, n in sizes.items()], "shard string, parts int")
    dealt = placed.join(F.broadcast(parts), "shard").withColumn("part", F.monotonically_increasing_id() % F.col("parts"))
    dealt.repartition(number, "shard", "part").select(*placed.columns).write.partitionBy("shard").parquet(path)
    return spark.read.schema(placed.schema).parquet(path).select(*placed.columns).toDF(*names)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards all documents, whole rows, into files and returns the placement as read back from these."""
    docs = read_table(spark, sf_dir, "documents")
    written = write_shards(docs, "doc_id", new_path(spark, "shards"))
    return written.select("doc_id", "slot", "shard")
