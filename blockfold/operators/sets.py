"""Unions and differences of sequence lists, and reads over a base and its delta."""

from __future__ import annotations

from pyspark.sql import DataFrame

KEY = ["account", "global_seq"]


def merge_dedupe(*lists: DataFrame) -> DataFrame:
    out = lists[0].select("global_seq")
    for x in lists[1:]:
        out = out.union(x.select("global_seq"))
    return out.distinct()


def delta_read(base: DataFrame, delta: DataFrame | None = None) -> DataFrame:
    """Compacted rows and newer ones, each (account, global_seq) once."""
    return (base if delta is None else base.unionByName(delta)).dropDuplicates(KEY)


def remove_compacted(delta: DataFrame, base: DataFrame) -> DataFrame:
    return delta.join(base.select(*KEY), KEY, "left_anti")
