"""Token ids in block files, each document compressed on its own with a shared zstandard dictionary.

A file is a table of blocks in doc_id order, written and read by Spark, so it
works on any store. A block holds

    shard, block        place in the order (shards are ranges of doc_id)
    start               ids of the shard before this block
    width               bytes of a serialized id: 2 where the vocabulary allows, else 4
    dictionary_hash     first 16 hex digits of SHA-256 of the dictionary
    index               per document: doc_id (int64), null flag, end offset (uint64), ids (uint64)
    payload             the documents' zstandard frames one after the other

A short document is read by its index entry alone: one slice of the payload,
one decompression. The dictionary is trained on serialized ids of a bounded
sample of documents, and stored beside the blocks under its hash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, give_back, id_key, partitions, small, table, text_key, work_folder, written
from .packing import tokenizer_path
from .tokens import encoder

END_ID = 2
#: The dictionary's training sample (documents, bytes from the middle of each one's ids) and size.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 32_768, 65_536
BLOCK_BYTES = 4_000_000
LEVEL = 1
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("end", "<u8"), ("n", "<u8")])
BLOCKS = "shard int, block int, start long, width int, dictionary_hash string, index binary, payload binary"


def width_of(tokenizer) -> int:
    return 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4


def middle(ids: bytes, size: int) -> bytes:
    at = max(0, (len(ids) - size) // 2) // 4 * 4
    return ids[at : at + size]


def encoded(df: DataFrame, tokenizer: str, spaces: bool, end_id: int, dictionary: bytes = b"", cut: int = 0) -> DataFrame:
    """doc_id, n, ids: serialized ids of each document with the end id; compressed if a dictionary is given, else `cut` bytes of their middle."""
    schema = "doc_id long, n long, ids binary"
    out = arrow(schema)
    end = np.asarray([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tokens = encoder(tokenizer, spaces)
        ids_of, narrow = tokens.ids, width_of(tokens.tokenizer) == 2
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        shrink = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared).compress
        for batch in small(batches):
            ids = [ids_of(t or "") + end for t in batch["text"].to_pylist()]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            if narrow:
                ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            yield pa.record_batch([batch["doc_id"], n, pa.array([middle(x, cut) if cut else shrink(x) for x in ids], pa.binary())], schema=out)
        give_back()

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, schema)


def train(df: DataFrame, tokenizer: str, spaces: bool, end_id: int) -> bytes:
    """A dictionary from SAMPLE_DOCS documents of least hash (ties by text); b"" where the sample has too few ids for one of that size."""
    import zstandard

    keys = [id_key().alias("did"), text_key().alias("th")]
    least = df.select(*keys).distinct().orderBy(F.xxhash64("did"), "did", "th").limit(SAMPLE_DOCS)  # bounded
    rows = df.select("doc_id", "text", *keys).join(F.broadcast(least), ["did", "th"], "left_semi").dropDuplicates(["did", "th"])
    samples = sorted(bytes(r.ids) for r in encoded(rows, tokenizer, spaces, end_id, cut=SAMPLE_BYTES).select("ids").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        if len(samples) >= SAMPLE_DOCS and sum(map(len, samples)) > 10 * DICTIONARY_BYTES:
            raise  # not for want of ids
        return b""


def write_ids(df: DataFrame, path: str, tokenizer: str, spaces: bool = True, end_id: int = END_ID) -> None:
    """Write the ids of df's documents (doc_id, text) to `path`, in ascending doc_id order, nulls first.

    Null and empty texts are the end id alone; rows with equal doc_id keep a
    place each; other columns are ignored. A text of any length is one frame; a
    block holds more than BLOCK_BYTES only for a single document.
    """
    spark = df.sparkSession
    dictionary = train(df, tokenizer, spaces, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()[:16]
    width = width_of(encoder(tokenizer, spaces).tokenizer)
    spark.createDataFrame([(digest, dictionary)], "dictionary_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    rows = written(encoded(df, tokenizer, spaces, end_id, dictionary), "encoded")
    rows = rows.withColumn("_arrival", F.monotonically_increasing_id())
    order = ["doc_id", "_arrival"]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("_arrival")
    out = arrow(BLOCKS)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        entries: list[tuple] = []
        parts: list[bytes] = []
        held = ids = 0

        def flush() -> pa.RecordBatch:
            values = [shard, block, start, width, digest, np.asarray(entries, ENTRY).tobytes(), b"".join(parts)]
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, out, strict=True)], schema=out)

        for batch in small(batches):
            for doc_id, n, frame in zip(batch["doc_id"].to_pylist(), batch["n"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if held and held + len(frame) > BLOCK_BYTES:
                    yield flush()
                    block, start, entries, parts, held, ids = block + 1, start + ids, [], [], 0, 0
                held += len(frame)
                ids += n
                entries.append((doc_id or 0, doc_id is None, held, n))
                parts.append(frame)
        if entries:
            yield flush()
        give_back()

    dealt.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32[, ids] of every document of a file, the dictionary checked by its hash."""
    stored = {r[0]: bytes(r[1]) for r in spark.read.parquet(f"{path}/dictionary").collect()}  # one row
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    schema = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    out = arrow(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in small(batches, 1):
            for shard, start, width, digest, index, payload in zip(*(batch[c].to_pylist() for c in ("shard", "start", "width", "dictionary_hash", "index", "payload")), strict=True):
                dictionary = stored[digest]
                if hashlib.sha256(dictionary).hexdigest()[:16] != digest:
                    raise ValueError("dictionary does not match its hash")
                grow = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress
                entries = np.frombuffer(index, ENTRY)
                ends = entries["end"].tolist()
                n = entries["n"].astype(np.int64)
                ids = [grow(payload[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                if width == 2:
                    ids = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in ids]
                if [len(x) // 4 for x in ids] != n.tolist():
                    raise ValueError("a document's ids do not match its index entry")
                columns = [
                    pa.array(np.full(len(ids), shard, np.int32)),
                    pa.array(entries["doc_id"].copy(), pa.int64(), mask=entries["null"].astype(bool)),
                    pa.array(start + np.cumsum(n) - n),
                    pa.array(n),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    *[pa.array(ids, pa.binary())] * keep_ids,
                ]
                yield pa.record_batch(columns, schema=out)
        give_back()

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.mapInArrow(_totals, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))  # a row per shard
    return blocks.mapInArrow(read, schema).join(F.broadcast(bases), "shard").withColumn("start", F.col("start") + F.col("_base")).drop("shard", "_base")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        n = [int(np.frombuffer(x, ENTRY)["n"].sum(dtype=np.int64)) for x in batch["index"].to_pylist()]
        yield pa.record_batch([batch["shard"], pa.array(n, pa.int64())], names=["shard", "n"])


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark)
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read_ids(spark, path, keep_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
