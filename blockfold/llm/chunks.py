"""Chunks: some megabytes of whole documents as one compressed row, so that passes over texts move compressed bytes and exchange per-chunk blobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, small, written

CHUNK_BYTES = 8_000_000
#: size: bytes of the texts.
CHUNKS = "chunk long, size long, doc_ids binary, nulls binary, ends binary, data binary"


def chunked(df: DataFrame, size: int | None = None) -> DataFrame:
    """df's doc_id and text (null: empty) as a written table of chunks of about `size` (CHUNK_BYTES) bytes, a longer document in one of its own."""
    out, size = arrow(CHUNKS), size or CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shrink = zstandard.ZstdCompressor(level=1).compress
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            values = [
                part << 32 | number,
                held,
                np.array([i or 0 for i in ids], np.int64).tobytes(),
                np.array([i is None for i in ids], np.uint8).tobytes(),
                np.cumsum([len(t) for t in texts], dtype=np.int64).tobytes(),
                shrink(b"".join(texts)),
            ]
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, out, strict=True)], schema=out)

        for batch in small(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if ids and held + len(raw) > size:
                    yield flush()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(raw)
                held += len(raw)
        if ids:
            yield flush()

    return written(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CHUNKS), "chunks")


def bytes_of(chunks: DataFrame) -> int:
    """Bytes of all texts, however they were cut into chunks."""
    return chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def opened(batches: Iterator[pa.RecordBatch], sides: tuple[str, ...] = ()) -> Iterator[tuple]:
    """chunk, doc_ids, nulls, ends, data of each row, then per side column its blobs joined."""
    import zstandard

    for batch in small(batches, 1):
        for row in batch.to_pylist():
            data = zstandard.ZstdDecompressor().decompress(row["data"])
            yield (
                row["chunk"],
                np.frombuffer(row["doc_ids"], np.int64),
                np.frombuffer(row["nulls"], np.uint8).astype(bool),
                np.frombuffer(row["ends"], np.int64),
                np.frombuffer(data, np.uint8),
                *(row[s] or [] for s in sides),
            )


def with_side(chunks: DataFrame, side: DataFrame, name: str, how: str = "left") -> DataFrame:
    """chunks with the list of side's blobs (chunk, body) of each chunk."""
    return chunks.join(side.groupBy("chunk").agg(F.collect_list("body").alias(name)), "chunk", how)
