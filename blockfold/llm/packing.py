"""Best-fit packing of documents into fixed-length sequences, planned on the length histogram.

The plan never sees documents: it places counts of lengths, longest first,
each into the fullest sequences that still hold it. Sequences that received
the same lengths stay together as one group of consecutive ids. Documents then
take planned places by their rank within their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, numbered, small, table, written
from .tokens import encoder

CAPACITY = 4096
END_ID = 1


@dataclass
class Plan:
    """Runs sorted by (length, first rank): `copies` places per sequence over `count` sequences from `sequence` on."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    count: np.ndarray
    offset: np.ndarray
    base: dict[int, int]
    sequences: int


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Place counts of lengths, longest first, into the tightest sequences that hold them.

    Groups of equal sequences are split, never single sequences, so the work
    and the plan depend on the number of lengths, not of documents.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left: groups (first sequence, count)
    rooms: list[int] = []  # sorted
    runs: list[tuple[int, int, int, int, int]] = []
    total = 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in free:
                free[room] = []
                bisect.insort(rooms, room)
            free[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, count = free[room].pop()
                if not free[room]:
                    del free[room], rooms[i]
            else:
                room, first, count = capacity, total, -(-left // (capacity // length))
                total += count
            each = room // length
            # the tightest sequence stays the tightest until it is full
            full, rest = min(count, left // each), 0
            if full < count:
                rest = left - full * each
            for c in range(each):
                if full:
                    runs.append((length, rank, first, full, capacity - room + c * length))
                    rank += full
            if rest:
                for c in range(rest):
                    runs.append((length, rank, first + full, 1, capacity - room + c * length))
                    rank += 1
                put(room - rest * length, first + full, 1)
            put(room - each * length, first, full)
            put(room, first + full + bool(rest), count - full - bool(rest))
            left = histogram[length] - rank
    runs.sort()
    columns = np.asarray(runs, np.int64).reshape(-1, 5).T
    base, seen = {}, 0
    for length in sorted(histogram):
        base[length] = seen
        seen += histogram[length]
    return Plan(*columns, base=base, sequences=total)


def pieces_of(df: DataFrame, tokenizer: str, spaces: bool, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32[, ids]."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    out = arrow(schema)
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaces).ids
        for batch in small(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), *[part] * keep_ids))
            columns = zip(*rows, strict=True) if rows else [[]] * len(out)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def pack(df: DataFrame, tokenizer: str, spaces: bool = False, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Sequences of at most `capacity` tokens holding every document of df (doc_id, text).

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, ids (if
    kept), sequence_id, offset. A null or empty text is the end token alone.
    Documents longer than a sequence are cut into full sequences and a rest;
    nothing else is cut. Rows with equal or null doc_id are separate documents.
    Other columns are ignored; an empty table gives an empty result. A text of
    any length is encoded as one row. Ties in length are broken by doc_id.
    """
    pieces = written(pieces_of(df, tokenizer, spaces, capacity, end_id, keep_ids), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = best_fit(histogram, capacity)
    rows = numbered(pieces, "length", "doc_id", "piece", name="_row")
    shared = df.sparkSession.sparkContext.broadcast(plan)  # bounded by the capacity, not by documents
    fields = pieces.schema.names
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    out = arrow(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        bases = np.zeros(capacity + 1, np.int64)
        for k, v in p.base.items():
            bases[k] = v
        starts = bases[p.length] + p.rank  # rows in length order: runs lie one after the other
        for batch in small(batches):
            row = batch["_row"].to_numpy()
            run = np.searchsorted(starts, row, "right") - 1
            sequence = p.sequence[run] + (row - starts[run])
            yield pa.record_batch([*(batch[c] for c in fields), pa.array(sequence, pa.int64()), pa.array(p.offset[run], pa.int64())], schema=out)

    return rows.mapInArrow(place, schema)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep_ids=False)
