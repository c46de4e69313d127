"""A block history as DataFrames: the star schema every operator works on.

    blocks            block_num, slice_num, block_time, hour, glob_min, glob_max, n_actions
    transactions      slice_num, block_num, trx_index, trx_id
    actions           slice_num, block_num, block_time, hour, trx_index, trx_id, global_seq, action_ordinal,
                      creator_ordinal, receiver, contract, action, auths, data_index, quantity
    account_actions   account, contract, action, global_seq, block_num, hour, trx_index, is_auth
    hour_map          hour, min_seq, max_seq
    abis              contract, block_num, ord, cleared

`from_events` derives them from an event table; `History.load` reads stored ones.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import short
from ..operators.canonical import canonical_actions

START, BLOCK_SECONDS, SLICE_BLOCKS = 1_704_067_200, 1800, 100


class History:
    """The tables, each built when it is first asked for."""

    def __init__(self, actions: DataFrame, abis: DataFrame | None = None, slice_blocks: int = SLICE_BLOCKS, account_actions: DataFrame | None = None):
        self.actions, self.slice_blocks = actions, slice_blocks
        self._abis, self._account_actions = abis, account_actions

    @property
    def spark(self) -> SparkSession:
        return self.actions.sparkSession

    @cached_property
    def blocks(self) -> DataFrame:
        a = self.actions
        return a.groupBy("block_num").agg(
            F.first("slice_num").alias("slice_num"),
            F.min("block_time").alias("block_time"),
            F.min("hour").alias("hour"),
            F.min("global_seq").alias("glob_min"),
            F.max("global_seq").alias("glob_max"),
            F.count("*").alias("n_actions"),
        )

    @cached_property
    def transactions(self) -> DataFrame:
        return self.actions.select("slice_num", "block_num", "trx_index", "trx_id").distinct()

    @cached_property
    def account_actions(self) -> DataFrame:
        return self._account_actions if self._account_actions is not None else canonical_actions(self.actions)

    @cached_property
    def hour_map(self) -> DataFrame:
        return self.actions.groupBy("hour").agg(F.min("global_seq").alias("min_seq"), F.max("global_seq").alias("max_seq"))

    @cached_property
    def abis(self) -> DataFrame:
        if self._abis is None:
            raise ValueError("no ABI log")
        return self._abis

    @classmethod
    def load(cls, spark: SparkSession, path: str, slice_blocks: int = SLICE_BLOCKS) -> History:
        return cls(spark.read.parquet(f"{path}/actions"), spark.read.parquet(f"{path}/abis"), slice_blocks, spark.read.parquet(f"{path}/account_actions"))

    def save(self, path: str) -> None:
        """Write actions by slice and account_actions clustered by account, contract, action and sequence, with Bloom filters for look-ups."""
        self.actions.write.mode("overwrite").partitionBy("slice_num").option("parquet.bloom.filter.enabled#trx_id", "true").parquet(f"{path}/actions")
        keys = ["account", "contract", "action", "global_seq"]
        clustered = self.account_actions.repartitionByRange(*keys).sortWithinPartitions(*keys)
        clustered.write.mode("overwrite").option("parquet.bloom.filter.enabled#account", "true").parquet(f"{path}/account_actions")
        if self._abis is not None:
            self._abis.write.mode("overwrite").parquet(f"{path}/abis")


def from_events(events: DataFrame) -> History:
    """A history out of events (event_id, ts, user_id, event_type, value, props): half-hour blocks, transactions of four actions."""
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    base = events.select(
        (F.col("event_id") + 1).alias("global_seq"),
        s.alias("s"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.col("user_id"),
        F.col("event_type"),
        F.round(F.col("value") * 10000).cast("long").alias("quantity"),
    )
    base = base.select("*", (F.floor((F.col("s") - START) / BLOCK_SECONDS) + 2).cast("long").alias("block_num"))
    in_block = Window.partitionBy("block_num").orderBy("global_seq")
    rows = base.withColumn("_pos", F.row_number().over(in_block) - 1).withColumn("trx_index", F.floor(F.col("_pos") / 4).cast("long"))
    rows = rows.withColumn("action_ordinal", (F.col("_pos") % 4 + 1).cast("long"))
    in_trx = Window.partitionBy("block_num", "trx_index").orderBy("global_seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own, own_contract = short(F.col("user_id"), "u"), short(F.col("k") % 10, "c")
    rows = rows.select(
        "*",
        F.first(own).over(in_trx).alias("sender"),
        F.first(own_contract).over(in_trx).alias("c0"),
        F.first("event_type").over(in_trx).alias("a0"),
        F.first(F.col("k") % 3).over(in_trx).alias("d0"),
        own.alias("own"),
        own_contract.alias("own_contract"),
    )
    n, inner = F.col("action_ordinal"), F.col("action_ordinal") <= 3
    auths = F.when((F.col("global_seq") - 1) % 5 == 0, F.array_distinct(F.array("sender", "own"))).otherwise(F.array("sender"))
    actions = rows.select(
        F.floor((F.col("block_num") - 1) / SLICE_BLOCKS).cast("long").alias("slice_num"),
        "block_num",
        F.timestamp_seconds("s").alias("block_time"),
        F.floor(F.col("s") / 3600).cast("long").alias("hour"),
        "trx_index",
        F.sha2(F.concat(F.col("block_num").cast("string"), F.lit(":"), F.col("trx_index").cast("string")), 256).alias("trx_id"),
        "global_seq",
        "action_ordinal",
        F.when(n == 4, 0).otherwise(n - 1).cast("long").alias("creator_ordinal"),
        F.when(n == 1, F.col("c0")).when(n == 2, F.col("sender")).when(n == 3, F.col("own")).otherwise(F.col("own_contract")).alias("receiver"),
        F.when(inner, F.col("c0")).otherwise(F.col("own_contract")).alias("contract"),
        F.when(inner, F.col("a0")).otherwise(F.col("event_type")).alias("action"),
        auths.alias("auths"),
        F.when(inner, F.col("d0")).otherwise(F.col("k") % 3).alias("data_index"),
        "quantity",
    )
    log = base.where("event_type = 'signup'").select(short(F.col("k") % 10, "c").alias("contract"), "block_num", F.col("global_seq").alias("ord"), (F.col("k") % 11 == 0).alias("cleared"))
    return History(actions, log)
