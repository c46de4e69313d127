"""Near-duplicates by 64-bit SimHash fingerprints and Golay-code fuzzy hashing.

Equal fingerprints are one class; candidate classes meet under a common Golay
key (see `golay`), and links are verified by counting differing bits. Within a
key, only links that connect are kept: each class is linked to one that was
reached before it. No pair within 4 bits stays unconnected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard
from .common import arrow, fresh, id_key, partitions, small, table, text_key, written
from .components import components
from .golay import pair_keys

MOST_BITS = 4
#: Classes under one key beyond which they are compared in pairs of blocks of this size, in separate tasks.
BLOCK = 50_000


def shingles(text: str | None, words: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `words` words of a text, in lower case; of the whole text where it has fewer."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) < words:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(tokens) - words + 1
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of a text: a bit is set where over half of the shingles' XXH64 have it."""
    hashes = shingles(text, words, seed)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int = 4) -> DataFrame:
    """df's doc_id and text key with its fingerprint as a signed long; null, empty and blank texts have 0."""
    out = arrow("doc_id long, text_key long, fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fp = np.array([fingerprint(x, words) for x in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch["doc_id"], batch["text_key"], pa.array(fp)], schema=out)

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def connect(x: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within `most` bits that connect whatever is connected among x; each class is compared only while unreached."""
    out = []
    left = x
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at, front = front[0], front[1:]
            near = np.bitwise_count(left ^ at) <= most
            if near.any():
                reached, left = left[near], left[~near]
                out.append((np.full(len(reached), at, np.uint64), reached))
                front = np.concatenate([front, reached])
    return out


def links_of_keys(keys: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """(n, 2) links among x with equal keys."""
    order = np.lexsort((x, keys))
    keys, x = keys[order], x[order]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
    found = []
    sizes = ends - starts
    two = starts[sizes == 2]
    near = np.bitwise_count(x[two] ^ x[two + 1]) <= most
    found.append((x[two][near], x[two + 1][near]))
    for a, b in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
        found += connect(x[a:b], most)
    pairs = np.stack([np.concatenate([f[i] for f in found]) for i in (0, 1)], 1)
    return np.unique(pairs, axis=0)


def links(classes: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """u, v: links that connect the distinct fingerprints `fp` of classes within `most` (up to 4) bits."""
    if most > 4:
        raise ValueError("the keys guarantee 4 bits")
    spark = classes.sparkSession
    key_schema, link_schema = "key int, fp long", "u long, v long"
    key_out, link_out = arrow(key_schema), arrow(link_schema)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            x = batch["fp"].to_numpy()
            rows, keys = pair_keys(x.view(np.uint64))
            yield pa.record_batch([pa.array(keys.astype(np.int32)), pa.array(x[rows])], schema=key_out)

    def linked(group: pa.Table) -> pa.Table:
        if not len(group):
            return link_out.empty_table()
        pairs = links_of_keys(group["key"].to_numpy(), group["fp"].to_numpy().view(np.uint64), most)
        return pa.table([pa.array(pairs[:, i].copy().view(np.int64)) for i in (0, 1)], schema=link_out)

    def blocks(group: pa.Table) -> pa.Table:
        """The classes of one pair of blocks of a large key."""
        x = group["fp"].to_numpy().view(np.uint64)
        found = connect(x, most)
        if not found:
            return link_out.empty_table()
        return pa.table([pa.array(np.concatenate([f[i] for f in found]).view(np.int64)) for i in (0, 1)], schema=link_out)

    keys = written(classes.select("fp").mapInArrow(keyed, key_schema), "keys")
    total = keys.count()
    buckets = max(partitions(spark), -(-total // 1_000_000))
    large = written(keys.groupBy("key").count().where(F.col("count") > BLOCK), "large")
    if large.isEmpty():
        usual, extra = keys, None
    else:
        usual = keys.join(large, "key", "left_anti")
        n = F.ceil(F.col("count") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        dealt = keys.join(large, "key").withColumn("n", n).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        extra = dealt.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp").groupBy("key", "a", "b").applyInArrow(blocks, link_schema)
    found = usual.groupBy(F.pmod(F.hash("key"), F.lit(buckets)).alias("bucket")).applyInArrow(linked, link_schema)
    return found if extra is None else found.union(extra)


def near_duplicates(df: DataFrame, words: int = 4, most: int = MOST_BITS, similarity: float | None = None) -> DataFrame:
    """doc_id, text_key, fp, root, component_id of every row of df (doc_id, text).

    component_id is the least doc_id that links reach, root the least
    fingerprint: where doc_ids repeat, components may share the former, never
    the latter.

    With a similarity, all texts whose sets of shingles overlap by at least
    that much (Jaccard) are linked too, however far apart their fingerprints
    are (see `jaccard`).
    Documents without words have fingerprint 0 and link like any other. Rows
    with a null doc_id are linked, but never name a component unless all of
    its doc_ids are null. Repeated rows and doc_ids give a row each; other
    columns are ignored; an empty table gives an empty result. A text of any
    length is one row and takes memory in proportion to its words.
    """
    rows = written(fingerprints(df, words), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    found = links(classes, most)
    if similarity is not None:
        found = found.union(jaccard.links(df, words, similarity))
    roots = written(components(found), "roots")
    classed = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = written(classed.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    named = written(classed.join(least, "root").select(F.col("fp").alias("class"), "root", "component_id"), "named")
    return rows.join(named, rows.fp == named["class"]).select("doc_id", "text_key", "fp", "root", "component_id")


def one_of_each(df: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of df that stay, one of each component of near_duplicates(df).

    It is the row of least doc_id (null last), of several the one of least text
    key; of rows equal in both the one whose columns are least in their order.
    """
    own = fresh(df, "did", "th", "rows")
    did, th, n = (own[k] for k in ("did", "th", "rows"))
    rows = found.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), id_key().alias("did"), "text_key", "n")).alias("least")
    stays = written(rows.groupBy("root").agg(least).select(F.col("least.did").alias(did), F.col("least.text_key").alias(th), F.col("least.n").alias(n)), "stays")
    keyed = df.withColumn(did, id_key()).withColumn(th, text_key())
    once = keyed.join(stays.where(F.col(n) == 1), [did, th]).select(*df.columns)
    several = stays.where(F.col(n) > 1)
    if several.isEmpty():
        return once
    equal = keyed.join(several, [did, th]).groupBy(did, th).agg(F.min(F.struct(*df.columns)).alias("row"))
    return once.union(equal.select("row.*"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
