"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Training counts of tokens and of token pairs are gathered over all documents:
chunks send distinct 64-bit (pairs: 40-bit) hashes with their counts to
buckets, which add them up. A pair's count c is quantised to q = 1 + floor(log2 c);
the filter holds the items (pair, 1) to (pair, q), so a pair found once has one.
Buckets are ranges of hashes, and each is a stretch of the filter of its own.
Their number follows from the bytes of all texts and a stretch's size from the
counts, so the filter, false positives included, and the scores depend on the
data alone and not on how they are partitioned.

The filter is broadcast to all workers if it has at most MAX_FILTER bytes.
Beyond that, each chunk's distinct pairs are sent to the stretches of their
hashes and the levels back: a constant number of passes whatever the corpus,
with the same answers.

A pair's level is found by asking for (pair, 1), (pair, 2), ... until one is
missing. The model interpolates

    P(w | v) = LAMBDA * min(1, m(q(v, w)) / c(v)) + (1 - LAMBDA) * (c(w) + 1) / (N + V + 1)

where m(q) is the mean count of all training pairs of level q (0 without one),
so that what quantising takes from some pairs it gives to others, and over all
contexts the mass of the pairs is what was counted. The first token follows a
start symbol, which stands as often as there are training documents. After a
token that training does not know, P is the second fraction alone. False
positives (2.4 % of unseen pairs at 8 bits an item) only raise scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import bytes_of, chunked, opened, with_side
from .common import arrow, table, written
from .suffixdedup import _batch, _blobs, _table, mixed

LAMBDA = 0.2
MAX_FILTER = 64_000_000
ITEM_BITS, PROBES = 8, 4
#: Stretches at least, and bytes of text for each where there are more.
LEAST_BUCKETS, BUCKET_BYTES = 64, 16_000_000
PAIR_BITS = 40
#: Training documents: those whose CRC-32 of doc_id as text leaves another remainder.
FOLDS, HELD_OUT = 7, 2
BLOBS = "kind int, bucket int, chunk long, body binary"
FOUND = "kind int, bucket int, chunk long, body binary, n long, v long"
TOKENS, PAIRS, LEVELS = 0, 1, 2
START = np.uint64(0x5BD1E9955BD1E995)


def held_out(doc_id: int | None) -> bool:
    """A null doc_id is a training document."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


class Tokens:
    """A chunk's tokens: distinct hashes, the place of each token's among them, and tokens per document (end included)."""

    def __init__(self, doc_ids: np.ndarray, nulls: np.ndarray, ends: np.ndarray, data: np.ndarray):
        from xxhash import xxh64_intdigest

        raw, words, counts, start = data.tobytes().lower(), [], [], 0
        for end in ends.tolist():
            own = raw[start:end].split()
            own.append(b"\n")
            words += own
            counts.append(len(own))
            start = end
        place = dict.fromkeys(words)
        hashes = np.fromiter((xxh64_intdigest(w) for w in place), np.uint64, len(place))
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        for w, k in zip(place, rank.tolist(), strict=True):
            place[w] = k
        self.hashes = hashes[order]
        self.at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        self.counts = np.array(counts, np.int64)
        self.held = np.array([not null and held_out(i) for i, null in zip(doc_ids.tolist(), nulls.tolist(), strict=True)], bool)
        self.starts = np.cumsum(self.counts) - self.counts

    def pairs(self) -> np.ndarray:
        """40-bit hashes of (token before, token)."""
        own = self.hashes[self.at]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[self.starts] = START
        return mixed(mixed(before) + own) >> np.uint64(64 - PAIR_BITS)


def pack_sorted(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending values as differences, byte by byte, with counts to 255 (larger ones apart), compressed."""
    import zstandard

    steps = np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, : PAIR_BITS // 8].T
    large = np.flatnonzero(counts > 254)
    head = np.array([len(values), len(large)], np.int64).tobytes()
    small = np.minimum(counts, 255).astype(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, steps.tobytes(), small.tobytes(), large.astype(np.int64).tobytes(), counts[large].astype(np.int64).tobytes()]))


def unpack_sorted(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(body)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    width = PAIR_BITS // 8
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.frombuffer(raw, np.uint8, n * width, 16).reshape(width, n).T
    counts = np.frombuffer(raw, np.uint8, n, 16 + n * width).astype(np.int64)
    at = 16 + n * (width + 1)
    counts[np.frombuffer(raw, np.int64, m, at)] = np.frombuffer(raw, np.int64, m, at + 8 * m)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64), counts


def item_bits(pair: np.ndarray, level: int, probe: int) -> np.ndarray:
    """Hash of a probe for (pair, level)."""
    return mixed(pair + np.uint64((level * PROBES + probe + 1) * 0x9E3779B97F4A7C15 % 2**64))


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count)."""
    return np.frexp(counts.astype(np.float64))[1]


def make_filter(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """The stretch of the filter for a bucket's pairs."""
    levels = levels_of(counts)
    items = int(levels.sum())
    size = max(1, items * ITEM_BITS // 8 + 1)
    bits = np.zeros(size * 8, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = pairs[levels >= level]
        for probe in range(PROBES):
            bits[(item_bits(own, level, probe) % np.uint64(size * 8)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Stretches of some buckets, for look-ups of arrays of pairs."""

    def __init__(self, stretches: dict[int, bytes | pa.Buffer], buckets: int):
        self.buckets = buckets
        self.sizes = np.zeros(buckets, np.int64)
        for k, body in stretches.items():
            self.sizes[k] = len(body)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(stretches[k] for k in sorted(stretches)), np.uint8)

    def quantised(self, pairs: np.ndarray, found: np.ndarray) -> None:
        """Raise `found` to the quantised count of each pair that is in these stretches."""
        bucket = bucket_of(pairs, self.buckets)
        left = np.flatnonzero(self.sizes[bucket] > 0)
        level = 1
        while len(left):
            for probe in range(PROBES):
                own = bucket[left]
                bit = (item_bits(pairs[left], level, probe) % (self.sizes[own] * 8).astype(np.uint64)).astype(np.int64)
                left = left[(self.bytes[self.starts[own] + (bit >> 3)] >> (bit & 7)) & 1 > 0]
            found[left] = level
            level += 1


def bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return ((pairs * np.uint64(buckets)) >> np.uint64(PAIR_BITS)).astype(np.int64)


def gather(group: pa.Table) -> list[tuple]:
    """One bucket: added-up counts, answered to each chunk (tokens) or made a stretch of the filter (pairs), with sums and numbers of counts by level."""
    kind, bucket = group["kind"][0].as_py(), group["bucket"][0].as_py()
    bodies, chunks = group["body"].to_pylist(), group["chunk"].to_pylist()
    if kind == PAIRS:
        parts = [unpack_sorted(b) for b in bodies]
        pairs, of = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        counts = np.bincount(of, np.concatenate([n for _, n in parts])).astype(np.int64)
        levels = levels_of(counts)
        sums, pairs_of = np.bincount(levels, counts), np.bincount(levels)
        out = [(LEVELS, bucket, k, b"", int(sums[k]), int(pairs_of[k])) for k in range(1, len(sums)) if pairs_of[k]]
        return [(kind, bucket, -1, make_filter(pairs, counts), 0, 0), *out]
    sizes = [len(b) // 16 for b in bodies]
    hashes = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(bodies, sizes, strict=True)])
    counts = np.concatenate([np.frombuffer(b, np.int64, n, 8 * n) for b, n in zip(bodies, sizes, strict=True)])
    _, of = np.unique(hashes, return_inverse=True)
    sums = np.bincount(of, counts).astype(np.int64)
    out = [(kind, bucket, -1, b"", int(sums.sum()), int((sums > 0).sum()))]
    total = sums[of]
    for chunk, end, n in zip(chunks, np.cumsum(sizes).tolist(), sizes, strict=True):
        out.append((kind, bucket, chunk, hashes[end - n : end].tobytes() + total[end - n : end].tobytes(), 0, 0))
    return out


def score(df: DataFrame, weight: float = LAMBDA, max_filter: int = MAX_FILTER) -> DataFrame:
    """Per row of df (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score and score.

    A null or empty text is the end token alone; other columns are ignored;
    repeated rows are learned from as often as they stand there and get a row
    each. A text of any length is one chunk's row and takes memory in
    proportion to its tokens. An empty table gives an empty result. Token
    hashes have 64 bits.
    """
    spark = df.sparkSession
    chunks = chunked(df)
    buckets = max(LEAST_BUCKETS, -(-bytes_of(chunks) // BUCKET_BYTES))
    blob_out, found_out = arrow(BLOBS), arrow(FOUND)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, doc_ids, nulls, ends, data in opened(batches):
            t = Tokens(doc_ids, nulls, ends, data)
            learned = np.repeat(~t.held, t.counts)
            n = np.bincount(t.at[learned], minlength=len(t.hashes)).astype(np.int64)
            rows = [(TOKENS, *r) for r in _blobs(chunk, ((t.hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), t.hashes, n)]
            pairs, n = np.unique(t.pairs()[learned], return_counts=True)
            cuts = np.searchsorted(bucket_of(pairs, buckets), np.arange(buckets + 1))
            rows += [(PAIRS, k, chunk, pack_sorted(pairs[a:b], n[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
            yield _batch(rows, blob_out)

    def gathered(group: pa.Table) -> pa.Table:
        return _table(gather(group), found_out)

    found = written(chunks.mapInArrow(count, BLOBS).groupBy("kind", "bucket").applyInArrow(gathered, FOUND), "counts")
    own_rows = found.where((F.col("kind") == TOKENS) & (F.col("chunk") == -1))
    train, vocabulary = own_rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    means = np.zeros(65)
    for r in found.where(F.col("kind") == LEVELS).groupBy("chunk").agg(F.sum("n"), F.sum("v")).collect():  # a row per level
        means[r[0]] = r[1] / r[2]
    means = np.maximum.accumulate(means)  # means rise with levels; one that only false positives reach counts as the one below
    stretches = found.where(F.col("kind") == PAIRS).select("bucket", "body")
    size = stretches.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
    source = with_side(chunks, found.where((F.col("kind") == TOKENS) & (F.col("chunk") >= 0)), "counts")
    if size <= max_filter:
        held = stretches.toArrow()  # at most max_filter bytes
        shared = spark.sparkContext.broadcast(Filter({k: body.as_buffer() for k, body in zip(held["bucket"].to_pylist(), held["body"], strict=True)}, buckets))
        del held
    else:
        shared = None
        source = with_side(source, asked(chunks, stretches, buckets), "answers")

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = arrow(schema)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in opened(batches, ("counts",) if shared else ("counts", "answers")):
            t = Tokens(*row[1:5])
            level = np.zeros(len(t.at), np.int64)
            if shared:
                shared.value.quantised(t.pairs(), level)
            else:
                _, place = np.unique(t.pairs(), return_inverse=True)
                level += np.concatenate([np.frombuffer(b, np.uint8, offset=4) for b in sorted(row[6])])[place]
            sent = [(np.frombuffer(b, np.uint64, len(b) // 16), np.frombuffer(b, np.int64, len(b) // 16, len(b) // 2)) for b in row[5]]
            hashes = np.concatenate([h for h, _ in sent])
            c = np.concatenate([n for _, n in sent])[np.argsort(hashes)][t.at]
            base = (c + 1.0) / (train + vocabulary + 1.0)
            before = np.empty(len(c), np.float64)
            before[1:] = c[:-1]
            before[t.starts] = c[t.starts + t.counts - 1]  # a document starts as often as it ends
            seen = np.minimum(1.0, means[level] / np.maximum(before, 1.0))
            model = np.log10(np.where(before > 0, weight * seen + (1 - weight) * base, base))
            total = lambda x, t=t: np.add.reduceat(x, t.starts)
            ids = pa.array(row[1].copy(), pa.int64(), mask=row[2])
            yield pa.record_batch(
                [ids, pa.array(t.held), pa.array(t.counts), pa.array(total((c > 0).astype(np.int64))), pa.array(np.full(len(t.counts), train, np.int64)), pa.array(total(np.log10(base))), pa.array(total(model))],
                schema=out,
            )

    return source.mapInArrow(final, schema)


def asked(chunks: DataFrame, stretches: DataFrame, buckets: int) -> DataFrame:
    """chunk, body: per chunk and bucket the levels of the chunk's distinct pairs in ascending order, behind the bucket's number (big-endian)."""
    question_out, answer_out = arrow("bucket int, chunk long, body binary"), arrow("chunk long, body binary")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, doc_ids, nulls, ends, data in opened(batches):
            pairs = np.unique(Tokens(doc_ids, nulls, ends, data).pairs())
            cuts = np.searchsorted(bucket_of(pairs, buckets), np.arange(buckets + 1)).tolist()
            yield _batch([(k, chunk, pack_sorted(pairs[a:b], np.zeros(b - a, np.int64))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a], question_out)

    def answer(questions: pa.Table, stretch: pa.Table) -> pa.Table:
        rows = []
        bits = {k: bytes(b) for k, b in zip(stretch["bucket"].to_pylist(), stretch["body"].to_pylist(), strict=True)}
        filter_ = Filter(bits, buckets)
        for bucket, chunk, body in zip(*(questions[c].to_pylist() for c in ("bucket", "chunk", "body")), strict=True):
            pairs, _ = unpack_sorted(body)
            level = np.zeros(len(pairs), np.uint8)
            filter_.quantised(pairs, level)
            rows.append((chunk, bucket.to_bytes(4, "big") + level.tobytes()))
        return _table(rows, answer_out)

    questions = chunks.mapInArrow(ask, "bucket int, chunk long, body binary")
    return written(questions.groupBy("bucket").cogroup(stretches.groupBy("bucket")).applyInArrow(answer, "chunk long, body binary"), "answers")


def op5_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
