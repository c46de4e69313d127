"""What the operators share: tables, work folders and row keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import work_folder

#: Rows of an Arrow batch that are handled at a time. Spark bounds a batch by bytes (64 MB).
ARROW_ROWS = 1000

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Free memory of this process back to the system, at the end of a task: a Python worker stays, beside the next task's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """For each name one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        own = f"_{name}"
        while own.lower() in taken:
            own += "_"
        taken.add(own.lower())
        out[name] = own
    return out


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared work folder: its lineage is cut, and a lost executor costs no recomputation."""
    path = f"{work_folder(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: str = "text") -> Column:
    """64 bits of a text (null as a text of its own)."""
    return F.xxhash64(F.col(text))


def id_key(doc_id: str = "doc_id") -> Column:
    """doc_id for equi joins: null meets null, at a value no other id has in practice."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63) + 11))


def numbered(df: DataFrame, *by: str, name: str = "row") -> DataFrame:
    """df with a global row number from 0 in the order of `by`; ties get numbers in any order.

    Rows are dealt by ranges of (by, arrival), so neither one key nor one row
    repeated many times gathers in a task. What is broadcast has a row per
    partition.
    """
    own = fresh(df, "arrival", "place", "part", "base")
    arrival, place, part, base = (own[k] for k in ("arrival", "place", "part", "base"))
    order = [*by, arrival]
    placed = written(
        df.withColumn(arrival, F.monotonically_increasing_id())
        .repartitionByRange(partitions(df.sparkSession), *order)
        .sortWithinPartitions(*order)
        .drop(arrival)
        .withColumn(place, F.monotonically_increasing_id()),
        "placed",
    )
    number = F.shiftright(place, 33)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(number.alias(part)).agg(F.count("*").alias("n"))
    bases = counts.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    return (
        placed.withColumn(part, number)
        .join(F.broadcast(bases), part)
        .withColumn(name, F.col(base) + F.col(place).bitwiseAND(2**33 - 1))
        .drop(part, base, place)
    )


def arrow(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string  # needs no session for plain DDL

    return to_arrow_schema(_parse_datatype_string(schema))


Query = Callable[[SparkSession, str], DataFrame]
__all__ = ["ARROW_ROWS", "Query", "arrow", "fresh", "give_back", "id_key", "numbered", "partitions", "small", "table", "text_key", "work_folder", "written"]
