"""Aggregates over accounts, blocks, slices and hours; posting lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 10_000
#: Sequences of a stretch, in which ranks are given; width of the stretches that ranges are looked up by.
STRETCH, RANGE_WIDTH = 1_000_000, 10_000


def account_stats(account_actions: DataFrame) -> DataFrame:
    return account_actions.groupBy("account").agg(
        F.count("*").alias("total"),
        F.min("global_seq").alias("first_seq"),
        F.max("global_seq").alias("last_seq"),
        F.min("hour").alias("first_hour"),
        F.max("hour").alias("last_hour"),
    )


def merge_hour_maps(*maps: DataFrame) -> DataFrame:
    """One map out of several; an entry without sequences (0, 0) adds nothing."""
    every = maps[0]
    for m in maps[1:]:
        every = every.unionByName(m)
    return every.where("min_seq <> 0 or max_seq <> 0").groupBy("hour").agg(F.min("min_seq").alias("min_seq"), F.max("max_seq").alias("max_seq"))


def seq_range_of_hours(hour_map: DataFrame, first: int, last: int) -> DataFrame:
    own = hour_map.where(F.col("hour").between(first, last))
    return own.agg(F.coalesce(F.min("min_seq"), F.lit(0)).alias("min_seq"), F.coalesce(F.max("max_seq"), F.lit(0)).alias("max_seq"))


def hours_to_seqs(hour_map: DataFrame, first: int, last: int) -> tuple[int, int]:
    return tuple(seq_range_of_hours(hour_map, first, last).first())


def in_ranges(values: DataFrame, value: str, ranges: DataFrame, least: str, most: str, width: int = RANGE_WIDTH) -> DataFrame:
    """Rows of values beside each range (both ends included) that holds their value.

    Ranges stand under every stretch of `width` numbers they touch and meet
    values by equality, so there is no nested loop over both sides.
    """
    spread = ranges.where(F.col(least) <= F.col(most)).withColumn("_at", F.explode(F.sequence(F.floor(F.col(least) / width), F.floor(F.col(most) / width))))
    near = values.withColumn("_at", F.floor(F.col(value) / width)).join(spread, "_at").drop("_at")
    return near.where(F.col(value).between(F.col(least), F.col(most)))


def hour_of_seq(hour_map: DataFrame, seqs: DataFrame) -> DataFrame:
    """global_seq and the earliest hour whose range holds it."""
    found = in_ranges(seqs, "global_seq", hour_map, "min_seq", "max_seq").groupBy("global_seq").agg(F.min("hour").alias("hour"))
    return seqs.distinct().join(found, "global_seq", "left")


def stretches(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, _stretch, _n, _before: rows of each stretch of STRETCH sequences of a key, and of the stretches before it."""
    counts = rows.groupBy(*keys, F.floor(F.col("global_seq") / STRETCH).alias("_stretch")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def placed(rows: DataFrame, of: DataFrame, *keys: str) -> DataFrame:
    """rows of the stretches in `of` with `place`, from 0 in the order of sequences within their key.

    Ranks are given within a stretch, so no task holds more than STRETCH rows
    of a key, however many it has.
    """
    joined = rows.withColumn("_stretch", F.floor(F.col("global_seq") / STRETCH)).join(of, [*keys, "_stretch"])
    rank = F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy("global_seq"))
    return joined.withColumn("place", F.col("_before") + rank - 1).drop("_stretch", "_n", "_before")


def postings(account_actions: DataFrame, *keys: str) -> DataFrame:
    """Ascending sequences of each key as chunks of CHUNK: chunk, base, n, seqs. No list grows beyond a chunk."""
    rows = account_actions.select(*keys, "global_seq").distinct()
    rows = placed(rows, stretches(rows, *keys), *keys).withColumn("chunk", F.floor(F.col("place") / CHUNK).cast("long"))
    return rows.groupBy(*keys, "chunk").agg(F.min("global_seq").alias("base"), F.count("*").alias("n"), F.array_sort(F.collect_list("global_seq")).alias("seqs"))


def chunk_metadata(chunks: DataFrame, *keys: str) -> DataFrame:
    return chunks.groupBy(*keys).agg(F.count("*").alias("chunks"), F.min("base").alias("first_base"), F.max("base").alias("last_base"))


def block_summary(actions: DataFrame, told: DataFrame) -> DataFrame:
    """Per block: actions, accounts told, sequence range, and its first and last five sequences if it has more than fifty."""
    accounts = told.groupBy("block_num").agg(F.countDistinct("account").alias("accounts"))
    lists = F.array_sort(F.collect_list("global_seq"))
    own = actions.groupBy("block_num").agg(F.count("*").alias("n_actions"), F.min("global_seq").alias("min_seq"), F.max("global_seq").alias("max_seq"), lists.alias("_seqs"))
    ends = F.when(F.col("n_actions") > 50, F.concat(F.slice("_seqs", 1, 5), F.slice("_seqs", -5, 5))).otherwise(F.col("_seqs"))
    return own.join(accounts, "block_num").select("block_num", "n_actions", "accounts", "min_seq", "max_seq", F.array_join(ends.cast("array<string>"), ",").alias("shown"))


def slice_stats(blocks: DataFrame) -> DataFrame:
    """Per slice: blocks, actions, and the blocks (lowest number first) with fewest and most actions."""
    n = F.col("n_actions")
    return blocks.groupBy("slice_num").agg(
        F.count("*").alias("blocks"),
        F.sum(n).alias("actions"),
        F.min(n).alias("min_actions"),
        F.max(n).alias("max_actions"),
        F.min(F.struct(n, F.col("block_num")))["block_num"].alias("min_block"),
        F.min(F.struct(-n, F.col("block_num")))["block_num"].alias("max_block"),
    )


def slice_compare(stats: DataFrame, one: int, other: int) -> DataFrame:
    a, b = (stats.where(F.col("slice_num") == k).select("blocks", "actions") for k in (one, other))
    a, b = a.toDF("blocks_a", "actions_a"), b.toDF("blocks_b", "actions_b")
    ratio = lambda x, y: F.when(F.col(y) != 0, F.round(F.col(x) / F.col(y), 6))
    density = F.round((F.col("actions_a") / F.col("blocks_a")) / (F.col("actions_b") / F.col("blocks_b")), 6)
    return a.crossJoin(b).select(ratio("blocks_a", "blocks_b").alias("block_ratio"), ratio("actions_a", "actions_b").alias("action_ratio"), density.alias("density_ratio"))  # one row each


def glob_total(blocks: DataFrame) -> DataFrame:
    span = F.when(F.col("glob_max") >= F.col("glob_min"), F.col("glob_max") - F.col("glob_min") + 1)
    return blocks.agg(F.coalesce(F.sum(span), F.lit(0)).alias("total"))
