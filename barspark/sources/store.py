"""Bars as partitioned Parquet: immutable revisions of batches, read by their recorded state.

A store is a folder of bars, partitioned down to revision and year, and beside it a table of its
revisions, a row each. A revision counts from its row on: bars are written first. What a later
revision supersedes, and what was processed from that, is kept but no longer active.
"""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.operators.intervals import superseded
from barspark.operators.validate import between, duplicate_keys, violations
from barspark.schema import BAR_SCHEMA, either, true

IDENTITY = ["layer", "provider", "timeframe"]
STORED = T.StructType([*BAR_SCHEMA.fields, *[T.StructField(c, T.StringType()) for c in (*IDENTITY, "revision")], T.StructField("year", T.IntegerType())])
REVISIONS = "revision string, layer string, provider string, timeframe string, pipeline string, parents array<string>, supersedes array<string>, rows long, first_ts timestamp, last_ts timestamp"

_own: list[str] = []


class OverlapError(ValueError):
    pass


class RequestError(ValueError):
    """A batch with bad bars, or not what was asked for."""


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, else the warehouse, else, in a local session, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local["):
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="store-"))
        folder = _own[0]
    folder = folder or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet table at ``path``; empty while nothing is stored."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def revisions(spark: SparkSession, path: str) -> DataFrame:
    """All recorded revisions, with ``active``."""
    found = _table(spark, f"{path}.revisions", REVISIONS)
    return superseded(found.withColumnsRenamed({"revision": "revision_id", "parents": "parent_ids"})).withColumnsRenamed({"revision_id": "revision", "parent_ids": "parents"})


def _chosen(spark: SparkSession, path: str, ids: list[str]) -> dict:
    """The identity that active raw revisions share; anything else raises ``ValueError``."""
    if not ids or len(set(ids)) < len(ids):
        raise ValueError("name different revisions, one at least")
    rows = [r for r in _recorded(spark, path) if r.revision in ids]
    if len(rows) < len(ids) or not all(r.active and r.layer == "raw" for r in rows):
        raise ValueError("the revisions must be active raw ones")
    if len({(r.provider, r.timeframe) for r in rows}) > 1:
        raise ValueError("the revisions must share provider and timeframe")
    return {c: rows[0][c] for c in IDENTITY}


def _recorded(spark: SparkSession, path: str) -> list[Row]:
    """The rows of :func:`revisions`, one a stored batch; their names then prune the folders that are read."""
    text = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("first_ts", "last_ts")}
    return revisions(spark, path).withColumns(text).collect()


def _of(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    return _table(spark, path, STORED).where(F.col("revision").isin(list(ids)))


def read_inputs(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """The bars of several active raw revisions of one identity, by symbol and time."""
    _chosen(spark, path, ids)
    rows = _of(spark, path, ids).select(*BAR_SCHEMA.names)
    if duplicate_keys(rows).limit(1).count():
        raise ValueError("the revisions share keys")
    return rows.orderBy("symbol", "ts")


def overlaps(bars: DataFrame, path: str, ids: list[str]) -> DataFrame:
    """Bounds of the stored revisions ``ids`` that meet those of the batch, by symbol."""
    own = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    had = _of(bars.sparkSession, path, ids).groupBy("symbol", "revision").agg(F.min("ts").alias("c"), F.max("ts").alias("d"))
    return own.join(had, "symbol").where("a <= d and c <= b")


def publish(bars: DataFrame, path: str, layer: str, provider: str, timeframe: str, revision: str, supersedes: list[str] = (), parents: list[str] = (), pipeline: str = "", symbols: list[str] | None = None, bounds: tuple[str, str] | None = None) -> None:
    """Append a batch as ``revision``, check it as it is written, and record it.

    Bars that break a rule, repeated keys, symbols that are not asked for, bars outside the asked ``[start, end)`` of ``bounds``, bars of days or longer
    that do not start at midnight, and an overlap of an active batch are refused: what was
    written is deleted, and without a row in the table of revisions it never counted. The batch is evaluated once: its
    metrics are observed on the way to the files, and keys and ends are read back from these.

    One writer at a time publishes to a store: two that check before either records its row both pass.
    """
    spark = bars.sparkSession
    bars = bars.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in BAR_SCHEMA])
    known = _recorded(spark, path)
    if any(r.revision == revision for r in known):
        raise ValueError(f"the revision {revision} is there already")
    odd = {"invalid": either(list(violations().values())) | F.col("symbol").isNull() | F.col("ts").isNull()}
    if symbols is not None:
        odd["other_symbol"] = ~F.col("symbol").isin(list(symbols))
    if bounds is not None:
        a, b = (F.lit(x).cast("timestamp") for x in bounds)
        odd["out_of_bounds"] = (F.col("ts") < a) | (F.col("ts") >= b)
    if not timeframe.endswith(("m", "h")):
        odd["not_midnight"] = F.col("ts") != F.date_trunc("day", "ts")
    tags = {"layer": layer, "provider": provider, "timeframe": timeframe, "revision": revision}
    seen = Observation()
    tagged = bars.observe(seen, *[F.count_if(true(c)).alias(n) for n, c in odd.items()]).withColumns({k: F.lit(v) for k, v in tags.items()} | {"year": F.year("ts")})
    (tagged.repartition("symbol", "year").sortWithinPartitions("symbol", "ts").write.mode("append").option("compression", "zstd").partitionBy(*IDENTITY, "revision", "year").parquet(path))
    written = _of(spark, path, [revision])
    same = (layer, provider, timeframe, pipeline)
    live = [r.revision for r in known if r.active and (r.layer, r.provider, r.timeframe, r.pipeline) == same and r.revision not in supersedes]
    try:
        if faults := {n: k for n, k in seen.get.items() if k}:
            raise RequestError(f"the batch has {faults}")
        if not duplicate_keys(written).isEmpty():
            raise RequestError("the batch has repeated keys")
        if live and not overlaps(written, path, live).isEmpty():
            raise OverlapError("the batch overlaps a stored one")
    except ValueError:
        _delete(spark, f"{path}/layer={layer}/provider={provider}/timeframe={timeframe}/revision={revision}")
        raise
    row = written.agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    strings = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    row = row.withColumns({k: F.lit(v) for k, v in tags.items()} | {"pipeline": F.lit(pipeline), "parents": strings(parents), "supersedes": strings(supersedes)})
    row.select("revision", *IDENTITY, "pipeline", "parents", "supersedes", "rows", "first_ts", "last_ts").write.mode("append").parquet(f"{path}.revisions")


def ingest(bars: DataFrame, path: str, provider: str, timeframe: str, revision: str, symbols: list[str], start: str, end: str) -> None:
    """A raw batch as an answer to a request: it holds only the asked ``symbols`` and times."""
    publish(bars, path, "raw", provider, timeframe, revision, symbols=symbols, bounds=(start, end))


def audit(spark: SparkSession, path: str) -> DataFrame:
    """``(revision, rows, invalid, repeated, agrees)`` of every recorded revision, active or not, from one pass over all stored bars.

    ``agrees``: its bars are as many and lie between the same ends as recorded, none breaks a rule and no key repeats. A recorded revision without
    bars has none of them.
    """
    broken = either(list(violations().values()))
    by_key = _table(spark, path, STORED).groupBy("revision", "symbol", "ts").agg(F.count("*").alias("n"), F.count_if(broken).alias("bad"))
    found = by_key.groupBy("revision").agg(F.sum("n").alias("_rows"), F.sum("bad").alias("invalid"), F.sum(F.col("n") - 1).alias("repeated"), F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    same = (F.col("_rows") == F.col("rows")) & F.col("_first").eqNullSafe(F.col("first_ts")) & F.col("_last").eqNullSafe(F.col("last_ts")) & (F.col("invalid") == 0) & (F.col("repeated") == 0)
    return revisions(spark, path).join(found, "revision", "left").select("revision", F.coalesce("_rows", F.lit(0)).alias("rows"), F.coalesce("invalid", F.lit(0)).alias("invalid"), F.coalesce("repeated", F.lit(0)).alias("repeated"), F.coalesce(same, F.col("rows") == 0).alias("agrees"))


def write_batch(bars: DataFrame, path: str, layer: str, provider: str, timeframe: str, revision: str) -> None:
    publish(bars, path, layer, provider, timeframe, revision)


def write_processed(bars: DataFrame, path: str, parents: list[str], pipeline: str, revision: str, timeframe: str | None = None) -> None:
    """What ``pipeline`` made of active raw revisions; the same inputs by the same pipeline are refused."""
    spark = bars.sparkSession
    own = _chosen(spark, path, parents)
    if not pipeline or any(r.active and r.pipeline == pipeline and sorted(r.parents) == sorted(parents) for r in _recorded(spark, path)):
        raise ValueError("the inputs were processed by this pipeline already, or it has no name")
    publish(bars, path, "processed", own["provider"], timeframe or own["timeframe"], revision, parents=parents, pipeline=pipeline)


def replace(bars: DataFrame, path: str, target: str, revision: str) -> None:
    """A new revision in place of ``target``, with the same first and last bar of each symbol."""
    spark = bars.sparkSession
    own = _chosen(spark, path, [target])
    bounds = lambda df: df.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    old, new = bounds(read_inputs(spark, path, [target])), bounds(bars)
    if old.exceptAll(new).union(new.exceptAll(old)).limit(1).count():
        raise ValueError("a replacement must have the first and last bars of its target")
    publish(bars, path, **own, revision=revision, supersedes=[target])


def refresh(bars: DataFrame, path: str, targets: list[str], revision: str) -> None:
    """A fetched range in place of ``targets``: it may revise and add bars, and must have every stored key."""
    spark = bars.sparkSession
    own = _chosen(spark, path, targets)
    lost = read_inputs(spark, path, targets).select("symbol", "ts").join(bars.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
    if lost.limit(1).count():
        raise ValueError("the batch lacks stored bars")
    publish(bars, path, **own, revision=revision, supersedes=targets)


def merge(spark: SparkSession, path: str, targets: list[str], chunks: list[tuple[str, str, DataFrame]], revision: str) -> None:
    """Stored revisions and fetched gaps ``(start, end, bars)`` as one; stored bars stay as they are.

    Gaps are disjoint, hold their bars, and do not reach into what a target covers of their symbols.
    """
    own = _chosen(spark, path, targets)
    spans = sorted((start, end) for start, end, _ in chunks)
    if not chunks or any(a[1] > b[0] for a, b in zip(spans, spans[1:])):
        raise ValueError("name disjoint gaps, one at least")
    stored = read_inputs(spark, path, targets)
    covered = _of(spark, path, targets).groupBy("symbol", "revision").agg(F.min("ts").alias("c"), F.max("ts").alias("d"))
    whole = stored
    for start, end, bars in chunks:
        a, b = (F.lit(x).cast("timestamp") for x in (start, end))
        if bars.where((F.col("ts") < a) | (F.col("ts") >= b)).limit(1).count():
            raise ValueError("a chunk has bars outside its gap")
        if bars.select("symbol").distinct().join(covered, "symbol").where((a <= F.col("d")) & (b > F.col("c"))).limit(1).count():
            raise OverlapError("a gap overlaps what is stored")
        whole = whole.union(bars.select(*BAR_SCHEMA.names))
    publish(whole, path, **own, revision=revision, supersedes=targets)


def compact(spark: SparkSession, path: str, targets: list[str], revision: str) -> None:
    """Several revisions as one, which supersedes them; their keys are disjoint."""
    if len(targets) < 2:
        raise ValueError("name two revisions at least")
    own = _chosen(spark, path, targets)
    publish(read_inputs(spark, path, targets), path, **own, revision=revision, supersedes=targets)


def scan(spark: SparkSession, path: str, layer: str, timeframe: str, start: str, end: str, symbols: list[str] | None = None, columns: list[str] | None = None, revisions_: list[str] | None = None, history: bool = False, provider: str | None = None, pipeline: str | None = None) -> DataFrame:
    """Bars in ``[start, end)`` sorted by symbol and time: of active revisions, of those named, or of all with ``history``.

    Partition columns, revisions and the year prune files, times and symbols prune row groups. Batches
    of more than one provider or pipeline that reach into the range raise ``ValueError``.
    """
    since, until = (datetime.fromisoformat(x).isoformat(" ", "microseconds") for x in (start, end))
    chosen = [
        r for r in _recorded(spark, path)
        if (r.layer, r.timeframe) == (layer, timeframe) and (r.revision in revisions_ if revisions_ else history or r.active)
        and provider in (None, r.provider) and pipeline in (None, r.pipeline) and r.rows and r.first_ts < until and r.last_ts >= since
    ]
    if len({(r.provider, r.pipeline) for r in chosen}) > 1:
        raise ValueError("the rows have more than one identity")
    rows = between(_of(spark, path, [r.revision for r in chosen]).where(F.col("year").between(int(start[:4]), int(end[:4]))), start, end)
    if symbols:
        rows = rows.where(F.col("symbol").isin(symbols))
    return rows.select(*(columns or BAR_SCHEMA.names)).orderBy("symbol", "ts")


def write_results(tables: dict[str, DataFrame], path: str, run: str) -> None:
    """Named result tables of a run, and a manifest row of the run with its time and its tables."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/run={run}/table={name}")
    row = spark.range(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("created_at"), F.array(*map(F.lit, sorted(tables))).alias("tables"))
    row.write.mode("append").parquet(f"{path}.runs")


def read_results(spark: SparkSession, path: str, run: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/run={run}/table={name}")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The recorded runs, the newest first."""
    return _table(spark, f"{path}.runs", "run string, created_at timestamp, tables array<string>").orderBy(F.desc("created_at"), "run")


def write_csv(bars: DataFrame, path: str) -> None:
    bars.write.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'").csv(path)
