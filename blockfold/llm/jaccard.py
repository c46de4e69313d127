"""All pairs of texts whose sets of shingles overlap by at least a given Jaccard similarity s.

Shingles are put in one order for all texts: those that a sample of texts has
often come last, ties go by hash. Two sets with similarity s or more share at
least ceil(s * n) shingles for n the size of either, so the first that they
share is among the first n - ceil(s * n) + 1 of both: texts are candidates if
they meet under one of these (prefix filtering), and no pair is missed whatever
the sample holds. Candidates are verified on their whole sets.

Under each shingle, all texts are first compared with the least of them; then
those that are not connected yet are compared with each other. Where c of the
first shingles are shared, and those of the set of n end before those of the
other in the order, no more than c + ceil(s * n) - 1 can be shared in all, nor
more than the smaller set has. Pairs for which this is too few are not verified.

Under a shingle of more than FEW texts, pairs are not made but within a task,
block by block, from parity bitmaps: the bits of a set's shingles added up
modulo 2. Two bitmaps differ in no more bits than their sets in shingles, so a
pair whose bitmaps differ in more than (1 - s) / (1 + s) of the sets' sizes
together is none, and only the others leave the task, each from the least of
such shingles that both have. These are few beyond the similar pairs
themselves, however many texts a common passage has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, partitions, small, text_key, written
from .components import components

#: Texts in the sample; shingles of at least COMMON of them come last, of which the most frequent ones are broadcast.
SAMPLE, COMMON, MOST_COMMON = 20_000, 3, 200_000
#: Slack for products of a similarity and a count.
EPS = 1e-9
#: Texts under a shingle up to which pairs are rows at once; beyond that they are compared in pairs of blocks of at most BLOCK.
FEW, BLOCK = 16, 4096
#: Bits of a parity bitmap: four times the shingles or more, a power of two within these bounds.
LEAST_BITS, MOST_BITS = 256, 8192


def parity(sets: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set of hashes, as 64-bit words."""
    bits = LEAST_BITS
    while bits < min(4 * len(sets), MOST_BITS):
        bits *= 2
    odd = np.bincount((sets & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bitmaps: list[np.ndarray], words: int) -> np.ndarray:
    """Bitmaps of so many or more words, each folded to that length."""
    return np.stack([np.bitwise_xor.reduce(b.reshape(-1, words), axis=0) for b in bitmaps])


def close_pairs(n: np.ndarray, side: np.ndarray, root: np.ndarray, bitmaps: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs of different roots and, if there are two, sides, whose sizes and bitmaps allow the similarity.

    A bitmap is at least as long as that of a smaller set, and at most twice as
    long if the sizes allow the similarity (which is over 0.5).
    """
    words = np.fromiter(map(len, bitmaps), np.int64, len(bitmaps))
    two = len(np.unique(side)) > 1
    differ = (1 - similarity) / (1 + similarity)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for w in np.unique(words).tolist():
        own, near = np.flatnonzero(words == w), np.flatnonzero((words == w) | (words == 2 * w))
        a, b = folded([bitmaps[k] for k in own], w), folded([bitmaps[k] for k in near], w)
        step = max(1, 4_000_000 // (len(near) * w))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            bits = np.bitwise_count(a[at : at + step, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)
            total = n[part][:, None] + n[near][None, :]
            good = (bits <= differ * total + EPS) & (np.minimum(n[part][:, None], n[near][None, :]) >= similarity / (1 + similarity) * total - EPS)
            good &= (root[part][:, None] != root[near][None, :]) & ((part[:, None] < near[None, :]) | (words[near] > w)[None, :])
            if two:
                good &= side[part][:, None] != side[near][None, :]
            i, j = np.nonzero(good)
            found.append((part[i], near[j]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))


def prefix(sets: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a set under which it is looked for, in order; common ascends."""
    return ordered_prefix(sets, common, counts, similarity)[0]


def ordered_prefix(sets: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The prefix, and how often the sample has its last shingle."""
    n = len(sets)
    length = n - int(np.ceil(similarity * n - EPS)) + 1
    times = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, sets), len(common) - 1)
        times = np.where(common[at] == sets, counts[at], 0)
    order = np.lexsort((sets, times))[:length]
    return sets[order], int(times[order[-1]])


def links(df: DataFrame, words: int, similarity: float) -> DataFrame:
    """u, v: fingerprints of texts of df (text) that connect all pairs of texts of at least that similarity (over 0.5); texts without words have none."""
    from .simhash import fingerprint, shingles

    spark = df.sparkSession
    text = F.col("text").cast("string").alias("text")
    texts = df.select(text_key().alias("node"), text).where(F.col("text").isNotNull())

    seen_out = arrow("key long")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [np.unique(shingles(t, words)) for t in batch["text"].to_pylist()]
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], schema=seen_out)

    part = max(1, df.count() // SAMPLE)
    seen = texts.where(F.pmod("node", F.lit(part)) == 0).dropDuplicates(["node"]).select("text").mapInArrow(sampled, "key long")
    often = seen.groupBy("key").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(MOST_COMMON).toArrow()  # bounded
    common, counts = often["key"].to_numpy().view(np.uint64), often["count"].to_numpy()
    order = np.argsort(common)
    shared_order = spark.sparkContext.broadcast((common[order], counts[order]))

    key_schema = "key long, node long, n int, last_times int, last long"
    key_out = arrow(key_schema)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [np.unique(shingles(t, words)) for t in batch["text"].to_pylist()]
            found = [ordered_prefix(s, *shared_order.value, similarity) if len(s) else (s, 0) for s in sets]
            keys = [k for k, _ in found]
            last = np.array([k[-1] if len(k) else 0 for k in keys], np.uint64) ^ np.uint64(1 << 63)  # signed, in the same order
            sizes = np.fromiter(map(len, keys), np.int64, len(keys))
            columns = [
                np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64),
                np.repeat(batch["node"].to_numpy(), sizes),
                np.repeat(np.fromiter(map(len, sets), np.int32, len(sets)), sizes),
                np.repeat(np.array([t for _, t in found], np.int32), sizes),
                np.repeat(last.view(np.int64), sizes),
            ]
            yield pa.record_batch([pa.array(c) for c in columns], schema=key_out)

    shared_schema = f"{key_schema}, m int, hub long, hub_n int, hub_times int, hub_last long"
    shared_out = arrow(shared_schema)

    def met(group: pa.Table) -> pa.Table:
        """The rows of keys that more than one text has, each once, with the number of the key's texts and the least of them."""
        key, node = group["key"].to_numpy(), group["node"].to_numpy()
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        order, key = order[new], key[new]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        m, hub = np.repeat(sizes, sizes), np.repeat(starts, sizes)
        use = m > 1
        rows = group.select(key_out.names).take(order[use])
        hubs = group.select(["node", "n", "last_times", "last"]).take(order[hub[use]])
        return pa.table([*rows.columns, pa.array(m[use].astype(np.int32)), *hubs.columns], schema=shared_out)

    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(partitions(spark), chars // 30_000_000)  # some million rows each, at six characters a word
    keys = texts.mapInArrow(keyed, key_schema)
    shared = written(keys.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInArrow(met, shared_schema), "shared")

    set_schema = "node long, fp long, body binary"
    set_out, link_schema = arrow(set_schema), "u long, v long, fp_u long, fp_v long"
    link_out = arrow(link_schema)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            own = batch["text"].to_pylist()
            fp = np.array([fingerprint(t, words) for t in own], np.uint64).view(np.int64)
            yield pa.record_batch([batch["node"], pa.array(fp), pa.array([np.unique(shingles(t, words)).tobytes() for t in own], pa.binary())], schema=set_out)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            good = []
            for a, b in zip(batch["body_u"], batch["body_v"], strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - EPS)
            yield batch.select(link_out.names).filter(pa.array(good, pa.bool_())).cast(link_out)

    def likely(shares: DataFrame) -> DataFrame:
        """u, v of the pairs of SHARES, a row per shared key, that share keys enough."""
        n, m = F.col("n_u"), F.col("n_v")
        ends_first = F.struct(F.col("times_u").alias("t"), F.col("last_u").alias("l")) <= F.struct(F.col("times_v").alias("t"), F.col("last_v").alias("l"))
        least = similarity / (1 + similarity) * (n + m) - EPS
        behind = F.ceil(similarity * F.when(ends_first, n).otherwise(m) - EPS) - 1
        pairs = shares.where(F.least(n, m) >= least).groupBy("u", "v").agg(F.count("*").alias("c"), F.first(behind).alias("behind"), F.first(least).alias("least"))
        return pairs.where(F.col("c") + F.col("behind") >= F.col("least")).select("u", "v")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that are similar enough."""
        pairs = written(pairs, f"{name}_pairs")
        involved = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        sets = written(texts.join(involved, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(bodies, set_schema), f"{name}_sets")
        a = sets.select(F.col("node").alias("u"), F.col("fp").alias("fp_u"), F.col("body").alias("body_u"))
        b = sets.select(F.col("node").alias("v"), F.col("fp").alias("fp_v"), F.col("body").alias("body_v"))
        return written(pairs.join(a, "u").join(b, "v").select(*link_out.names, "body_u", "body_v").mapInArrow(verified, link_schema), name)

    def side(rows: DataFrame, name: str) -> DataFrame:
        own = {"node": name, "n": f"n_{name}", "last_times": f"times_{name}", "last": f"last_{name}", "root": f"root_{name}"}
        return rows.select("key", *(F.col(c).alias(x) for c, x in own.items()))

    names = ["u", "v", "n_u", "n_v", "times_u", "last_u", "times_v", "last_v"]
    pair_schema = "u long, v long"
    pair_out = arrow(pair_schema)
    bit_schema = "node long, bits binary"
    bit_out = arrow(bit_schema)

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [parity(np.unique(shingles(t, words))).tobytes() for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["node"], pa.array(found, pa.binary())], schema=bit_out)

    def compared(group: pa.Table) -> pa.Table:
        """The pairs of a key, or of two blocks of its texts, that sizes and bitmaps allow."""
        own = [np.frombuffer(b, np.uint64) for b in group["bits"].to_pylist()]
        i, j = close_pairs(group["n"].to_numpy().astype(np.int64), group["own"].to_numpy(), group["root"].to_numpy(), own, similarity)
        node, keys = group["node"].to_numpy(), group["keys"].to_pylist()
        here = group["key"][0].as_py() if len(group) else 0
        before = [frozenset(k for k in x if k < here) for x in keys]
        once = np.fromiter((before[a].isdisjoint(before[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
        i, j = i[once], j[once]
        return pa.table([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], schema=pair_out)

    hub = [F.col(c).alias(x) for c, x in zip(["hub", "node", "hub_n", "n", "hub_times", "hub_last", "last_times", "last"], names, strict=True)]
    found = verify(likely(shared.where("node <> hub").select(*hub)), "first")
    roots = written(components(found.select("u", "v")), "reached")
    placed = shared.select(*key_out.names, "m").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # keys with one component left need no more
    open_keys = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    left = written(placed.join(open_keys, "key", "left_semi"), "left")
    few = left.where(F.col("m") <= FEW)
    # pairs that meet under a shingle of many texts as well may be missed here, but not there
    pairs = likely(side(few, "u").join(side(few, "v"), "key").where("u < v and root_u <> root_v").select(*names))
    many = left.where(F.col("m") > FEW)
    if not many.isEmpty():
        keys_of = many.groupBy("node").agg(F.collect_set("key").alias("keys"))  # a part of the node's own prefix
        bits = texts.join(many.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).mapInArrow(bitmaps, bit_schema)
        bits = written(bits.join(keys_of, "node"), "bitmaps")
        dealt = many.join(bits, "node").withColumn("n_blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        dealt = dealt.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "n", "root", "bits", "keys")
        pairs = pairs.union(dealt.groupBy("key", "a", "b").applyInArrow(compared, pair_schema)).distinct()
    more = verify(pairs, "rest")
    return found.union(more).select(F.col("fp_u").alias("u"), F.col("fp_v").alias("v"))
