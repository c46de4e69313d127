"""Integrity checks: gaps, duplicates, bounds, and the report over them.

Checks that look at neighbours work per slice, so no window spans the whole
history; edges of slices are compared in a table with a row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR, WARNING = "ERROR", "WARNING"


def issue(df: DataFrame, severity: str, kind: str, block: Column | str = "block_num") -> DataFrame:
    block = F.col(block) if isinstance(block, str) else block
    return df.select("slice_num", block.cast("long").alias("block_num"), F.lit(severity).alias("severity"), F.lit(kind).alias("kind"))


def _steps(blocks: DataFrame) -> DataFrame:
    before = Window.partitionBy("slice_num").orderBy("block_num")
    return blocks.withColumn("prev", F.lag("block_num").over(before)).withColumn("prev_max", F.lag("glob_max").over(before))


def block_gaps(blocks: DataFrame) -> DataFrame:
    """Missing stretches between neighbours of a slice."""
    return _steps(blocks).where("block_num > prev + 1").select("slice_num", (F.col("prev") + 1).alias("first_missing"), (F.col("block_num") - 1).alias("last_missing"))


def missing_blocks(blocks: DataFrame) -> DataFrame:
    return block_gaps(blocks).select("slice_num", F.explode(F.sequence("first_missing", "last_missing")).alias("block_num"))


def missing_ranges(blocks: DataFrame) -> DataFrame:
    """Missing blocks as consecutive ranges with their sizes, per slice: the gaps as they are, none spelt out."""
    return block_gaps(blocks).withColumn("n", F.col("last_missing") - F.col("first_missing") + 1)


def top_affected(blocks: DataFrame, n: int = 5) -> DataFrame:
    """The slices with most missing blocks."""
    return missing_ranges(blocks).groupBy("slice_num").agg(F.sum("n").alias("missing")).orderBy(F.desc("missing"), "slice_num").limit(n)


def glob_gaps(blocks: DataFrame) -> DataFrame:
    """Blocks with actions that don't follow on the sequences before them."""
    full = _steps(blocks.where("glob_max >= glob_min"))
    return full.where("glob_min <> prev_max + 1").select("slice_num", "block_num", "glob_min", "prev_max")


def duplicate_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("slice_num", "block_num").agg(F.count("*").alias("n")).where("n > 1")


def out_of_range(blocks: DataFrame, size: int) -> DataFrame:
    return blocks.where((F.col("block_num") < F.col("slice_num") * size + 1) | (F.col("block_num") > (F.col("slice_num") + 1) * size))


def missing_action(blocks: DataFrame, actions: DataFrame, contract: str, action: str) -> DataFrame:
    """Blocks after the second without a system action."""
    have = actions.where((F.col("contract") == contract) & (F.col("action") == action)).select("block_num").distinct()
    return blocks.where("block_num > 2").join(have, "block_num", "left_anti")


def slice_edges(blocks: DataFrame) -> DataFrame:
    """Per slice its bounds and the slice's before it: a row per slice, so one task orders them."""
    bounds = blocks.groupBy("slice_num").agg(F.min("block_num").alias("min_block"), F.max("block_num").alias("max_block"), F.countDistinct("block_num").alias("n"))
    return bounds.withColumn("prev_max_block", F.lag("max_block").over(Window.orderBy("slice_num")))


def slice_overlaps(blocks: DataFrame) -> DataFrame:
    return slice_edges(blocks).where("min_block <= prev_max_block").select("slice_num", "min_block", "prev_max_block")


def slice_gaps(blocks: DataFrame) -> DataFrame:
    return slice_edges(blocks).where("min_block > prev_max_block + 1").select("slice_num", "min_block", "prev_max_block")


def completeness(blocks: DataFrame, size: int) -> DataFrame:
    """Per slice: expected and found blocks, and whether it is complete; the first slice may begin at block 2."""
    expected = F.when((F.col("slice_num") == 0) & (F.col("min_block") == 2), size - 1).otherwise(size).cast("long")
    out = slice_edges(blocks).withColumn("expected", expected)
    return out.select("slice_num", "expected", F.col("n").alias("found"), (F.col("n") == F.col("expected")).alias("complete"))


def continuity(blocks: DataFrame) -> DataFrame:
    """Per slice: gaps in blocks, gaps in sequences, and whether actions match the sequences' span."""
    steps = _steps(blocks)
    return steps.groupBy("slice_num").agg(
        F.sum(F.when(F.col("block_num") > F.col("prev") + 1, 1).otherwise(0)).alias("block_gaps"),
        F.sum(F.when(F.col("glob_min") != F.col("prev_max") + 1, 1).otherwise(0)).alias("seq_gaps"),
        (F.sum("n_actions") == F.sum(F.col("glob_max") - F.col("glob_min") + 1)).alias("counts_match"),
    )


def missing_files(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Slices of a manifest (slice_num) of which no file is there (present: slice_num)."""
    gone = manifest.join(present.select("slice_num").distinct(), "slice_num", "left_anti")
    return gone.select("slice_num", F.lit(ERROR).alias("severity"), F.lit("MISSING_FILE").alias("kind"))


def empty_slices(manifest: DataFrame, blocks: DataFrame) -> DataFrame:
    """Slices of a manifest without any block."""
    gone = manifest.join(blocks.select("slice_num").distinct(), "slice_num", "left_anti")
    return gone.select("slice_num", F.lit(WARNING).alias("severity"), F.lit("EMPTY_INDEX").alias("kind"))


def ingest_violations(actions: DataFrame) -> DataFrame:
    """Actions that must not be taken in: the receipt names another receiver, or authorizations and their sequences differ in number."""
    other = F.col("receiver") != F.col("receipt_receiver")
    counts = F.size("auth_seqs") != F.size("auths")
    rule = F.when(other, "RECEIPT_RECEIVER").when(counts, "AUTH_COUNT")
    return actions.withColumn("rule", rule).where("rule is not null").select("global_seq", "rule")


def enforce(actions: DataFrame) -> DataFrame:
    """actions; evaluating one that breaks an invariant is an error."""
    wrong = (F.col("receiver") != F.col("receipt_receiver")) | (F.size("auth_seqs") != F.size("auths"))
    seq = F.when(wrong, F.raise_error(F.concat(F.lit("ingest invariant broken at "), F.col("global_seq").cast("string"))).cast("long")).otherwise(F.col("global_seq"))
    return actions.withColumn("global_seq", seq)


def first_slices(blocks: DataFrame, size: int, max_blocks: int) -> DataFrame:
    """slice_num of the leading slices that have at most max_blocks blocks together, one at least; 0: all. A row per slice is ordered."""
    slices = blocks.select("slice_num").distinct()
    if not max_blocks:
        return slices
    return slices.orderBy("slice_num").limit(max(1, max_blocks // size))


def validate(blocks: DataFrame, actions: DataFrame, size: int, contract: str, action: str, mode: str = "FAST", max_blocks: int = 0) -> DataFrame:
    """Findings by mode: FAST looks at blocks, FULL at sequences too, ONBLOCK also for the system action of each block."""
    if mode not in ("FAST", "FULL", "ONBLOCK"):
        raise ValueError(f"unknown mode {mode!r}")
    if max_blocks:
        own = first_slices(blocks, size, max_blocks)
        blocks = blocks.join(own, "slice_num", "left_semi")
        actions = actions.join(own, "slice_num", "left_semi")
    found = [
        issue(out_of_range(blocks, size), ERROR, "BLOCK_OUT_OF_RANGE"),
        issue(duplicate_blocks(blocks), ERROR, "DUPLICATE_BLOCK"),
        issue(missing_blocks(blocks), ERROR, "MISSING_BLOCK"),
        issue(slice_overlaps(blocks), ERROR, "OVERLAPPING_SLICES", "min_block"),
        issue(slice_gaps(blocks), WARNING, "SLICE_GAP", "min_block"),
    ]
    if mode == "FULL":
        found.append(issue(glob_gaps(blocks), ERROR, "SEQUENCE_GAP"))
    if mode == "ONBLOCK":
        found.append(issue(missing_action(blocks, actions, contract, action), ERROR, "MISSING_ONBLOCK"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def issues(blocks: DataFrame, actions: DataFrame, size: int, contract: str, action: str) -> DataFrame:
    """All findings as one table."""
    found = [
        issue(out_of_range(blocks, size), ERROR, "BLOCK_OUT_OF_RANGE"),
        issue(duplicate_blocks(blocks), ERROR, "DUPLICATE_BLOCK"),
        issue(missing_blocks(blocks), ERROR, "MISSING_BLOCK"),
        issue(missing_action(blocks, actions, contract, action), ERROR, "MISSING_ONBLOCK"),
        issue(slice_overlaps(blocks), ERROR, "OVERLAPPING_SLICES", "min_block"),
        issue(slice_gaps(blocks), WARNING, "SLICE_GAP", "min_block"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def report(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "kind").agg(F.count("*").alias("n"), F.countDistinct("slice_num").alias("slices"))


def verdict(found: DataFrame) -> DataFrame:
    """One row: n findings, how many of them are errors, and the status; no findings are 0 and passed."""
    errors = F.when(F.col("severity") == ERROR, F.col("n"))
    counts = report(found).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(name) for name, n in (("n", F.col("n")), ("errors", errors))))
    return counts.withColumn("status", F.when(F.col("errors") > 0, "failed").otherwise("passed"))


def passed(found: DataFrame) -> bool:
    """A history fails on errors, not on warnings."""
    return found.where(F.col("severity") == ERROR).isEmpty()
