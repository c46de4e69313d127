"""Latest value at or before a place: ABIs as of a block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Numbers of `order` that a window holds.
STRETCH = 10_000


def asof(left: DataFrame, right: DataFrame, key: str, order: str, tie: str, value: str, stretch: int = STRETCH) -> DataFrame:
    """left with `value` of the last right row whose order is at most its own; of equal orders the greatest tie.

    One union and one window over (key, stretch of the order): no range join,
    and no task holds all rows of a key. What is in force at a stretch's begin
    is carried in as a row: of each stretch the last right row, brought on over
    the key's stretches, of which there are few. Rows of the right stand before
    rows of the left at the same place.
    """
    columns = [c for c in left.columns if c != key]
    kind = right.schema[value].dataType.simpleString()
    part = F.floor(F.col(order) / stretch).alias("_part")
    no_tie, no_value = F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.lit(None).cast(f"struct<v:{kind}>").alias("_value")
    l_rows = left.select(key, part, F.col(order).alias("_at"), F.lit(1).alias("_side"), no_tie, no_value, F.struct(*columns).alias("_row"))
    no_row = F.lit(None).cast(l_rows.schema["_row"].dataType).alias("_row")
    r_rows = right.select(key, part, F.col(order).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.struct(F.col(value).alias("v")).alias("_value"), no_row)
    ends = r_rows.groupBy(key, "_part").agg(F.max_by("_value", F.struct("_at", "_tie")).alias("_value"))
    spots = ends.unionByName(l_rows.select(key, "_part").distinct().withColumn("_value", no_value))
    spots = spots.groupBy(key, "_part").agg(F.first("_value", True).alias("_value"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.withColumn("_value", F.last("_value", True).over(earlier)).where("_value is not null")
    c_rows = carried.select(key, "_part", F.lit(None).cast(l_rows.schema["_at"].dataType).alias("_at"), F.lit(-1).alias("_side"), no_tie, "_value", no_row)
    until = Window.partitionBy(key, "_part").orderBy(F.asc_nulls_first("_at"), "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = l_rows.union(r_rows).union(c_rows).withColumn("_found", F.last("_value", True).over(until)).where("_side = 1")
    return found.select(key, "_row.*", F.col("_found.v").alias(value))


def abi_state(actions: DataFrame, abis: DataFrame) -> DataFrame:
    """actions with `abi_ord`, the ABI log's entry in force, null where there is none or it was cleared. An ABI holds for its whole block."""
    log = abis.withColumn("state", F.struct(F.col("ord").alias("ord"), F.col("cleared").alias("cleared")))
    found = asof(actions, log, "contract", "block_num", "ord", "state")
    return found.withColumn("abi_ord", F.when(~F.col("state.cleared"), F.col("state.ord"))).withColumn("abi_state", F.when(F.col("state").isNull(), "none").when(F.col("state.cleared"), "cleared").otherwise("set")).drop("state")
