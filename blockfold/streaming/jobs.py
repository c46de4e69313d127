"""Streams over stored actions.

A subscription catches up and then goes on from the same checkpoint: first with
`available_now`, later with a processing-time trigger. Nothing is lost or seen
twice in between. Upkeep jobs write each batch to a folder of its own number,
so a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.canonical import canonical_actions
from ..operators.filters import stream_matches
from ..operators.sets import delta_read
from ..operators.stats import merge_hour_maps

PUSHED = ["global_seq", "block_num", "receiver", "contract", "action"]


def source(spark: SparkSession, path: str, files: int = 2) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def run(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], interval: str | None = None, mode: str = "append") -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def accounts_of(contracts: Sequence[str], receivers: Sequence[str]) -> list[str]:
    """Accounts whose lists a catch-up reads: receivers if there are any, else contracts."""
    return list(receivers or contracts)


def catch_up(actions: DataFrame, contracts: Sequence[str] = (), names: Sequence[str] = (), receivers: Sequence[str] = (), start: int = 0) -> DataFrame:
    """What a subscription pushes from `start` on, each sequence once, in order."""
    own = actions.where(stream_matches(contracts, names, receivers) & (F.col("global_seq") >= start))
    return own.select(*PUSHED).distinct().orderBy("global_seq")


def subscribe(stream: DataFrame, contracts: Sequence[str] = (), names: Sequence[str] = (), receivers: Sequence[str] = ()) -> DataFrame:
    """The same rows as a stream; an action arrives once, so none needs removing."""
    return stream.where(stream_matches(contracts, names, receivers)).select(*PUSHED)


def maintain_index(stream: DataFrame, folder: str, interval: str | None = None, every: int = 0) -> StreamingQuery:
    """account_actions of each batch (whole blocks) as a delta folder per batch; every so many batches the deltas are compacted."""

    def each(df: DataFrame, n: int) -> None:
        canonical_actions(df).write.mode("overwrite").parquet(f"{folder}/delta/batch={n}")
        if every and n % every == every - 1:
            compact(df.sparkSession, folder, "delta", ["account", "contract", "action", "global_seq"])

    return run(stream, f"{folder}/checkpoint", each, interval)


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the delta folders that are there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at(folder)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at(folder))]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch="))


def _generation(spark: SparkSession, folder: str) -> int:
    """Number of the newest complete base: a batch number up to which deltas are in it; -1 without one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max((n for n in _batches(spark, f"{folder}/base") if fs.exists(at(f"{folder}/base/batch={n}/_SUCCESS"))), default=-1)


def compact(spark: SparkSession, folder: str, delta: str, keys: list[str], at_least: int = 1) -> bool:
    """Merge the deltas beyond the base into a new base, clustered by keys, if there are rows enough.

    The new base is a folder of its own, named by the last batch in it, and
    counts once it is complete; only then do older bases and its deltas go. A
    crash in between leaves an older base and all deltas, or both bases.
    """
    done = _generation(spark, folder)
    new = [n for n in _batches(spark, f"{folder}/{delta}") if n > done]
    if not new:
        return False
    rows = spark.read.parquet(*(f"{folder}/{delta}/batch={n}" for n in new))
    if at_least > 1 and rows.count() < at_least:
        return False
    merged(spark, folder, delta).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{folder}/base/batch={new[-1]}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f"base/batch={n}" for n in _batches(spark, f"{folder}/base") if n < new[-1]]
    old += [f"{delta}/batch={n}" for n in _batches(spark, f"{folder}/{delta}") if n <= new[-1]]
    for name in old:
        fs.delete(path(f"{folder}/{name}"), True)
    return True


def merged(spark: SparkSession, folder: str, delta: str) -> DataFrame:
    """The newest base and the deltas beyond it, each row once."""
    done = _generation(spark, folder)
    new = [n for n in _batches(spark, f"{folder}/{delta}") if n > done]
    paths = [f"{folder}/base/batch={done}"] * (done >= 0) + [f"{folder}/{delta}/batch={n}" for n in new]
    return spark.read.parquet(*paths).distinct()


def compacted(spark: SparkSession, folder: str) -> DataFrame:
    """Base and deltas of the account index together."""
    return delta_read(merged(spark, folder, "delta"))


def maintain_hours(stream: DataFrame, folder: str, interval: str | None = None) -> StreamingQuery:
    """Incremental hour map as a streaming aggregate; its state is a row per hour."""
    hours = stream.groupBy("hour").agg(F.min("global_seq").alias("min_seq"), F.max("global_seq").alias("max_seq"))
    return run(hours, f"{folder}/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/map/batch={n}"), interval, "update")


def hour_map(spark: SparkSession, folder: str) -> DataFrame:
    return merge_hour_maps(spark.read.parquet(f"{folder}/map").drop("batch"))


#: Entries of the transaction index from which its deltas are merged.
MERGE_ENTRIES = 5_000_000


def maintain_trx(stream: DataFrame, folder: str, interval: str | None = None, merge_entries: int = MERGE_ENTRIES) -> StreamingQuery:
    """The transaction index: a delta per batch, merged into the base once there are merge_entries new entries."""
    rows = stream.select(F.substring("trx_id", 1, 4).alias("trx_prefix"), "trx_id", "block_num")

    def each(df: DataFrame, n: int) -> None:
        df.distinct().write.mode("overwrite").parquet(f"{folder}/trx/batch={n}")
        compact(df.sparkSession, folder, "trx", ["trx_prefix", "trx_id"], merge_entries)

    return run(rows, f"{folder}/checkpoint", each, interval)


def trx_entries(spark: SparkSession, folder: str) -> DataFrame:
    return merged(spark, folder, "trx")


#: Blocks behind the last irreversible one from which a sync works in bulk.
BULK_THRESHOLD = 1000


def sync_mode(block: Column, lib: Column, threshold: int = BULK_THRESHOLD) -> Column:
    """`bulk` while a block is more than the threshold behind, else `live`."""
    return F.when(block + threshold < lib, "bulk").otherwise("live")


class ActionIndexer(Protocol):
    """A pluggable index: takes batches of actions, and merges what they left."""

    def add(self, actions: DataFrame, batch: int) -> None: ...

    def finish(self) -> None: ...


def sync(stream: DataFrame, indexer: ActionIndexer, checkpoint: str, on_progress: Callable[[dict], None] | None = None, interval: str | None = None) -> StreamingQuery | None:
    """Feed an index: all there is in bulk, then `catchup_complete`, then, with an interval, live from the same checkpoint."""
    tell = on_progress or (lambda event: None)

    def each(df: DataFrame, n: int) -> None:
        indexer.add(df, n)
        tell({"event": "batch", "batch": n, **progress(df)})

    run(stream, checkpoint, each).awaitTermination()
    indexer.finish()
    tell({"event": "catchup_complete"})
    return run(stream, checkpoint, each, interval) if interval else None


def progress(df: DataFrame) -> dict:
    """A heartbeat's numbers: rows, head block and last sequence of a batch."""
    r = df.agg(F.count("*").alias("rows"), F.max("block_num").alias("head"), F.max("global_seq").alias("last_seq")).first()
    return r.asDict()


def process_ids(stream: DataFrame, processor: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """A user's own work over transaction ids alone; batches hold whole blocks, so each id comes once."""
    ids = stream.select("block_num", "trx_index", "trx_id")
    return run(ids, checkpoint, lambda df, n: processor(df.distinct(), n), interval)


def process(stream: DataFrame, processor: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """A user's own index over whole batches."""
    return run(stream, checkpoint, processor, interval)
