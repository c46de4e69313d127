"""Transactions: look-ups by id prefix, their actions, their state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trx_index(transactions: DataFrame) -> DataFrame:
    """trx_prefix (two bytes in hex, the partition), trx_id, block_num."""
    return transactions.select(F.substring("trx_id", 1, 4).alias("trx_prefix"), "trx_id", "block_num")


def lookup(index: DataFrame, trx_id: str) -> DataFrame:
    """Blocks of a transaction: its partition first, then the whole id; of several the newest."""
    found = index.where((F.col("trx_prefix") == trx_id[:4]) & (F.col("trx_id") == trx_id))
    return found.orderBy(F.desc("block_num")).limit(1)


def with_actions(actions: DataFrame, trx_ids: list[str], roots_only: bool = False) -> DataFrame:
    """Per transaction its actions in sequence order, as an array."""
    own = actions.where(F.col("trx_id").isin(trx_ids))
    if roots_only:
        own = root_actions(own)
    item = F.struct("global_seq", "receiver", "contract", "action")
    return own.groupBy("trx_id", "block_num").agg(F.array_sort(F.collect_list(item)).alias("actions"))


def root_actions(actions: DataFrame) -> DataFrame:
    """Actions a user signed, not those that other actions made."""
    return actions.where(F.col("creator_ordinal") == 0)


def status(transactions: DataFrame, blocks: DataFrame, trx_ids: list[str]) -> DataFrame:
    """Block, state and head of transactions; history holds irreversible blocks only."""
    own = transactions.where(F.col("trx_id").isin(trx_ids))
    head = blocks.agg(F.max("block_num").alias("head"))
    found = own.join(blocks.select("block_num", "block_time"), "block_num")
    return found.crossJoin(F.broadcast(head)).select("trx_id", "block_num", F.lit("IRREVERSIBLE").alias("state"), "head")  # head: one row


def partitions(index: DataFrame) -> DataFrame:
    return index.groupBy("trx_prefix").agg(F.count("*").alias("entries"), F.min("block_num").alias("min_block"), F.max("block_num").alias("max_block"))
