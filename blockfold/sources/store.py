"""A stored history: opening, appending by slice, finalising, cutting back; the ABI log."""

from __future__ import annotations

import configparser
import json
import time
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import parse_setabi
from ..operators import integrity

BLOCK_LIMIT = 10_000


@dataclass(frozen=True)
class Config:
    """Settings of a store."""

    path: str
    slice_blocks: int = 10_000
    compression: str = "zstd"
    files_per_trigger: int = 100

    @classmethod
    def load(cls, path: str | None = None, section: str = "store", flags: Mapping[str, str] | None = None) -> Config:
        """Settings from an INI file, over which flags go; an unknown one is an error."""
        found: dict[str, str] = {}
        if path:
            parser = configparser.ConfigParser()
            with open(path) as f:
                parser.read_file(f)
            found = dict(parser[section])
        found |= {k.replace("-", "_"): v for k, v in (flags or {}).items()}
        kinds = {f.name: int if f.type == "int" else str for f in fields(cls)}
        if unknown := set(found) - set(kinds):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: kinds[k](v) for k, v in found.items()})


@dataclass
class Trace:
    """Steps of a request: component, what was done, seconds and rows."""

    steps: list[dict] = field(default_factory=list)

    @contextmanager
    def step(self, component: str, name: str) -> Iterator[dict]:
        entry = {"component": component, "name": name, "count": None}
        began = time.perf_counter()
        try:
            yield entry
        finally:
            entry["seconds"] = round(time.perf_counter() - began, 6)
            self.steps.append(entry)

    def to_json(self) -> str:
        return json.dumps({"steps": self.steps, "seconds": round(sum(s["seconds"] for s in self.steps), 6)})


def open_blocks(spark: SparkSession, source: str, table: str = "actions", config: Config | None = None) -> DataFrame:
    """A table of a store: `stream:PATH` follows it, any other path (file, object store) reads it as it is."""
    kind, _, path = source.partition(":")
    if kind in ("http", "https", "tcp"):
        raise ValueError(f"no source of kind {kind!r}: histories are read from files or object stores")
    if kind != "stream":
        return spark.read.parquet(f"{source}/{table}")
    schema = spark.read.parquet(f"{path}/{table}").schema
    files = config.files_per_trigger if config else 100
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/{table}")


def append_actions(actions: DataFrame, config: Config, batch: str | int | None = None) -> None:
    """Append a batch; a new slice begins a new partition by itself.

    A batch with a number is written once: it has partitions of its own, which
    a repeated attempt replaces. Without one, it is appended as it is. Rows go
    to tasks by ranges of (slice, sequence), so a large slice is many tasks.
    """
    own = actions.withColumn("slice_num", F.floor((F.col("block_num") - 1) / config.slice_blocks).cast("long"))
    own = own.repartitionByRange("slice_num", "global_seq").sortWithinPartitions("slice_num", "global_seq")
    writer = own.write if batch is None else own.withColumn("batch", F.lit(str(batch))).write
    by = ["slice_num"] if batch is None else ["slice_num", "batch"]
    mode = "append" if batch is None else "overwrite"
    writer.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", config.compression).partitionBy(*by).parquet(f"{config.path}/actions")


def finalise(blocks: DataFrame, config: Config) -> DataFrame:
    """Slices with a completeness verdict each."""
    return integrity.completeness(blocks, config.slice_blocks)


def digests(actions: DataFrame) -> DataFrame:
    """slice_num, digest: SHA-256 over a slice's blocks in order, each by the digests of its actions in order. A slice's list has a row per block."""
    record = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("global_seq", "receiver", "contract", "action"))), 256)
    blocks = actions.groupBy("slice_num", "block_num").agg(F.array_sort(F.collect_list(F.struct("global_seq", record.alias("d")))).alias("own"))
    blocks = blocks.select("slice_num", F.struct("block_num", F.sha2(F.array_join(F.col("own.d"), ""), 256).alias("d")).alias("b"))
    return blocks.groupBy("slice_num").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("b"))["d"], ""), 256).alias("digest"))


def write_finalised(actions: DataFrame, blocks: DataFrame, config: Config) -> DataFrame:
    """The flags: complete slices with their digests, written beside the actions and returned."""
    done = finalise(blocks, config).where("complete").join(digests(actions), "slice_num").select("slice_num", "found", "digest")
    done.write.mode("overwrite").parquet(f"{config.path}/finalised")
    return actions.sparkSession.read.schema(done.schema).parquet(f"{config.path}/finalised")


def cut_after(spark: SparkSession, config: Config, last_block: int) -> None:
    """Set the history back to a block.

    What the block's own slice keeps is written aside first, then that slice and
    the later ones are moved aside, the new slice takes its place, and only then
    what was moved goes. A crash leaves all rows in one of the three places; a
    repeated call puts back what an earlier one had moved, and goes on.
    """
    path, aside = f"{config.path}/actions", f"{config.path}/_aside"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(conf)
    if fs.exists(at(aside)):
        for status in fs.listStatus(at(aside)):
            name = status.getPath().getName()
            fs.delete(at(f"{path}/{name}"), True)
            fs.rename(status.getPath(), at(f"{path}/{name}"))
    rows = spark.read.parquet(path)
    last = max(0, (last_block - 1) // config.slice_blocks)
    own = rows.where((F.col("slice_num") == last) & (F.col("block_num") <= last_block))
    kept = own.drop("slice_num").write.mode("overwrite")
    (kept.partitionBy("batch") if "batch" in rows.columns else kept).parquet(f"{config.path}/_cut")
    fs.mkdirs(at(aside))
    for k in sorted(r[0] for r in rows.where(F.col("slice_num") >= last).select("slice_num").distinct().collect()):  # a row per slice
        fs.rename(at(f"{path}/slice_num={k}"), at(f"{aside}/slice_num={k}"))
    fs.rename(at(f"{config.path}/_cut"), at(f"{path}/slice_num={last}"))
    fs.delete(at(aside), True)


ABIS = "contract string, block_num long, ord long, abi_json string"


def append_abis(abis: DataFrame, path: str, batch: str | int) -> None:
    """Append entries (contract, block_num, ord, abi_json) to the ABI log; a repeated batch replaces itself."""
    abis.select("contract", "block_num", "ord", "abi_json").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def abi_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ABIS}, batch string").parquet(path).drop("batch")


#: The system contract, and its action that sets an ABI.
SYSTEM_CONTRACT, SET_ABI = "eosio", "setabi"


def rebuild_abis(actions: DataFrame, contract: str = SYSTEM_CONTRACT, action: str = SET_ABI) -> DataFrame:
    """The ABI log out of actions (block_num, global_seq, contract, action, data): a scan for setabi. Empty ABIs and data that do not fit add nothing."""
    found = actions.where((F.col("contract") == contract) & (F.col("action") == action)).select("block_num", F.col("global_seq").alias("ord"), parse_setabi("data").alias("abi"))
    return found.select("abi.contract", "block_num", "ord", "abi.abi_json").where("abi_json is not null")


def scan_block(table: DataFrame, block: int, slice_blocks: int) -> DataFrame:
    """Rows of a block; its slice prunes the partitions."""
    return table.where((F.col("slice_num") == max(0, (block - 1) // slice_blocks)) & (F.col("block_num") == block))


def scan_slice(table: DataFrame, number: int) -> DataFrame:
    """All rows of a slice: one partition's files, read in parallel."""
    return table.where(F.col("slice_num") == number)


def scan_range(table: DataFrame, first: int, last: int, slice_blocks: int) -> DataFrame:
    if last - first >= BLOCK_LIMIT:
        raise ValueError(f"at most {BLOCK_LIMIT} blocks")
    slices = F.col("slice_num").between(max(0, (first - 1) // slice_blocks), max(0, (last - 1) // slice_blocks))
    return table.where(slices & F.col("block_num").between(first, last))


def state(blocks: DataFrame) -> DataFrame:
    """Head and last irreversible block, which are the same in a history."""
    return blocks.agg(F.max("block_num").alias("head"), F.max("block_num").alias("lib"))


def first_available(blocks: DataFrame, block: int) -> DataFrame:
    return blocks.where(F.col("block_num") >= block).agg(F.min("block_num").alias("block_num"))


def slice_metadata(actions: DataFrame) -> DataFrame:
    return actions.groupBy(F.col("slice_num").cast("long").alias("slice_num")).agg(
        F.min("block_num").alias("min_block"), F.max("block_num").alias("max_block"), F.min("global_seq").alias("glob_min"), F.max("global_seq").alias("glob_max"), F.count("*").alias("n_actions")
    )


def refresh_slices(spark: SparkSession, path: str) -> DataFrame:
    """The cached metadata of a store's slices, brought up to date.

    Slices that are cached are not read again but for the last, which may have
    grown. The new cache is a folder of its own; the old one goes when it is
    complete.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = spark.read.parquet(f"{path}/actions")
    old = sorted(s.getPath().getName() for s in fs.listStatus(at(path)) if s.getPath().getName().startswith("slices_") and fs.exists(at(f"{s.getPath()}/_SUCCESS")))
    if old:
        known = spark.read.parquet(f"{path}/{old[-1]}")
        last = known.agg(F.max("slice_num")).first()[0]
        # slices come in order, so all beyond the last cached one are new
        made = known.where(F.col("slice_num") < last).unionByName(slice_metadata(rows.where(F.col("slice_num") >= last)))
    else:
        made = slice_metadata(rows)
    name = f"slices_{int(old[-1].partition('_')[2]) + 1 if old else 0:010d}"
    made.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")  # a row per slice
    for x in old:
        fs.delete(at(f"{path}/{x}"), True)
    return spark.read.parquet(f"{path}/{name}")


def rebuild_block_index(actions: DataFrame) -> DataFrame:
    return actions.groupBy("slice_num", "block_num").agg(F.min("global_seq").alias("glob_min"), F.max("global_seq").alias("glob_max"))
