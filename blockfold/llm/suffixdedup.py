"""Exact substring dedup: every byte covered by a repeated string of `length` bytes is removed.

Not a difference cover: a sample chosen by content stands for it, and equality
of hashes for the order of suffixes (README says why, with figures). Of each
string of `length` bytes (a window) one position is in the sample: that of its
least K-byte gram by hash. Equal windows have it at the same place, which is
what a difference cover gives for any two suffixes, with one position in 68
instead of one in eleven. The windows of one sample position form a segment.
Then, bucket by bucket, so that memory is bounded,

1. equal grams of the sample and equal segments are brought together. A gram
   found once ends there. A segment found twice is repeated as a whole, however
   long the tie around it.
2. what ties in its gram but not in its segment is resolved window by window:
   one bucket of windows at a time, equal ones are brought together.

Chunks exchange only distinct hashes with the buckets, each at most once per
chunk and value, so a passage in a third of all documents is no larger in a
bucket than any other. Grams, segments and windows are compared by 64-bit
hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import bytes_of, chunked, opened, with_side
from .common import arrow, partitions, table, written

LENGTH = 200
#: Bytes of a gram, for LENGTH; windows handled at a time; input bytes per bucket.
GRAM, SLICE, BUCKET_BYTES = 64, 500_000, 32_000_000
POSITION_BITS = 20
BASE = 0x9E3779B97F4A7C15
RESOLVED, EXPAND = 1, 2
BLOBS = "bucket int, chunk long, body binary"
SIDE = "chunk long, body binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0x94D049BB133111EB)


class Rolling:
    """Hashes of any substring of a slice from prefix sums modulo 2**64."""

    powers = np.zeros(0, np.uint64)
    inverses = np.zeros(0, np.uint64)
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(self.powers) < n + 1:
            ones = np.ones(max(n, SLICE + LENGTH) + 1, np.uint64)
            up, down = ones.copy(), ones
            up[1:], down[1:] = np.uint64(BASE), np.uint64(pow(BASE, -1, 2**64))
            Rolling.powers, Rolling.inverses = np.cumprod(up), np.cumprod(down)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.inverses[:n], out=self.prefix[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[end] - self.prefix[start]) * self.powers[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.prefix) - length
        return mixed((self.prefix[length:] - self.prefix[:-length]) * self.powers[:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by running minima in blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


class Segments(NamedTuple):
    """Of one slice: first window, number of windows, gram and segment hash of each segment; and the slice's hashes."""

    begin: int
    first: np.ndarray
    count: np.ndarray
    gram: np.ndarray
    hash: np.ndarray
    rolling: Rolling


def segments(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> Iterator[Segments]:
    width = length - gram + 1
    mask = np.uint64((1 << POSITION_BITS) - 1)
    for begin in range(0, max(0, len(data) - length + 1), SLICE):
        part = data[begin : begin + SLICE + length - 1]
        rolling = Rolling(part)
        grams = rolling.all(gram)
        least = sliding_least((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), width) & mask
        n = len(least)
        inside = np.ones(n + length, bool)  # windows that begin and end in one document
        for end in ends[np.searchsorted(ends, begin + 1) : np.searchsorted(ends, begin + n + length)].tolist():
            inside[max(0, end - begin - length + 1) : max(0, end - begin)] = False
        at = np.flatnonzero(inside[:n])
        if not len(at):
            continue
        anchor = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(new)
        first, count = at[heads], np.diff(np.concatenate([heads, [len(at)]]))
        place = anchor[heads].astype(np.int64)
        own = rolling.at(first, first + count + length - 1) + (count.astype(np.uint64) << np.uint64(32)) + (place - first).astype(np.uint64)
        yield Segments(begin, first, count, grams[place], mixed(own), rolling)


def _blobs(chunk: int, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One blob per bucket: each column's values one after the other."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), chunk, b"".join(c[part].tobytes() for c in columns)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, schema)], schema=schema)


def _unblob(bodies: list[bytes], *types: str) -> list[np.ndarray]:
    """The columns of blobs, joined."""
    width = sum(np.dtype(t).itemsize for t in types)
    columns: list[list[np.ndarray]] = [[] for _ in types]
    for body in bodies:
        n, at = len(body) // width, 0
        for k, t in enumerate(types):
            columns[k].append(np.frombuffer(body, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate([np.zeros(0, t), *c]) for c, t in zip(columns, types, strict=True)]


def _owner(group: pa.Table, width: int) -> np.ndarray:
    return np.repeat(group["chunk"].to_numpy(), [len(b) // width for b in group["body"].to_pylist()])


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and whether each stands there twice or more (as 1 or 2)."""
    values, n = np.unique(x, return_counts=True)
    return values, np.minimum(n, 2).astype(np.uint8)


def rank_grams(group: pa.Table) -> list[tuple[int, bytes]]:
    """Of one bucket of grams: per chunk, the segments to act on and how."""
    bodies = group["body"].to_pylist()
    gram, segment, n = _unblob(bodies, "<u8", "<u8", "u1")
    chunk = _owner(group, 17)
    order = np.lexsort((chunk, segment, gram))
    gram, segment, n, chunk = gram[order], segment[order], n[order].astype(np.int64), chunk[order]
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    new_segment = new_gram | np.concatenate([[True], segment[1:] != segment[:-1]])
    of_gram, of_segment = np.cumsum(new_gram) - 1, np.cumsum(new_segment) - 1
    several = np.bincount(of_gram, new_segment)[of_gram] > 1
    repeated = np.bincount(of_segment, n)[of_segment] > 1
    act = np.where(repeated, RESOLVED, 0) | np.where(several & new_segment, EXPAND, 0)
    use = act > 0
    return _per_chunk(chunk[use], segment[use], act[use].astype(np.uint8))


def _per_chunk(chunk: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    return [(c, body) for c, _, body in _blobs(0, chunk, *columns)]


def repeated_windows(group: pa.Table) -> list[tuple[int, bytes]]:
    """Of one bucket of windows: per chunk, those that stand anywhere else."""
    windows, n = _unblob(group["body"].to_pylist(), "<u8", "u1")
    chunk = _owner(group, 9)
    _, of = np.unique(windows, return_inverse=True)
    use = np.bincount(of, n)[of] > 1
    return _per_chunk(chunk[use], windows[use])


def _actions(s: Segments, segment: np.ndarray, act: np.ndarray) -> np.ndarray:
    """What to do with each segment of a slice."""
    if not len(segment):
        return np.zeros(len(s.hash), np.uint8)
    k = np.minimum(np.searchsorted(segment, s.hash), len(segment) - 1)
    return np.where(segment[k] == s.hash, act[k], 0).astype(np.uint8)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All windows of runs."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def _sorted_side(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    segment, act = _unblob(bodies, "<u8", "u1")
    order = np.argsort(segment)
    return segment[order], act[order]


def removal(df: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """Per row of df (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin, end in bytes)[, kept (bytes)].

    A null text is empty. Texts shorter than `length` lose nothing. Of repeated
    strings, within a text or between texts, every occurrence goes, that of
    repeated rows too. Other columns are ignored; an empty table gives an empty
    result. A text of any length is in one chunk and handled in slices. Cutting bytes may split a character of many bytes, so `kept` is
    binary.
    """
    spark = df.sparkSession
    gram = min(gram, length)
    chunks = chunked(df)
    buckets = max(partitions(spark), bytes_of(chunks) // BUCKET_BYTES)
    blob_out, side_out = arrow(BLOBS), arrow(SIDE)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, _, ends, data in opened(batches):
            parts = [(s.gram, s.hash) for s in segments(data, ends, length, gram)]
            if parts:
                grams, hashes = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                order = np.lexsort((hashes, grams))
                grams, hashes = grams[order], hashes[order]
                head = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (hashes[1:] != hashes[:-1])]))
                n = np.minimum(np.diff(np.concatenate([head, [len(grams)]])), 2).astype(np.uint8)
                grams = grams[head]
                yield _batch(list(_blobs(chunk, (grams >> np.uint64(20)) % np.uint64(buckets), grams, hashes[head], n)), blob_out)

    def ranked(group: pa.Table) -> pa.Table:
        return _table(rank_grams(group), side_out)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, _, ends, data, bodies in opened(batches, ("actions",)):
            segment, act = _sorted_side(bodies)
            found, seen = [], np.zeros(0, np.uint64)
            for s in segments(data, ends, length, gram):
                todo = _actions(s, segment, act)
                use = np.flatnonzero(todo & EXPAND)
                # of a segment that is repeated anyway, one copy stands for all
                known = use[(todo[use] & RESOLVED) > 0]
                once = known[~np.isin(s.hash[known], seen)]
                once = once[np.unique(s.hash[once], return_index=True)[1]]
                seen = np.concatenate([seen, s.hash[once]])
                use = np.concatenate([use[(todo[use] & RESOLVED) == 0], once])
                at = _spread(s.first[use], s.count[use])
                found.append(s.rolling.at(at, at + length))
            if found:
                x, n = _counted(np.concatenate(found))
                yield _batch(list(_blobs(chunk, (x >> np.uint64(20)) % np.uint64(buckets), x, n)), blob_out)

    def repeated(group: pa.Table) -> pa.Table:
        return _table(repeated_windows(group), side_out)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>" + ", kept binary" * texts
    out = arrow(schema)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, doc_ids, nulls, ends, data, bodies, hits in opened(batches, ("actions", "hits")):
            segment, act = _sorted_side(bodies)
            (again,) = _unblob(hits, "<u8")
            again = np.sort(again)
            change = np.zeros(len(data) + 1, np.int32)
            for s in segments(data, ends, length, gram) if len(segment) else ():
                todo = _actions(s, segment, act)
                whole = np.flatnonzero(todo & RESOLVED)
                np.add.at(change, s.begin + s.first[whole], 1)
                np.add.at(change, s.begin + s.first[whole] + s.count[whole] + length - 1, -1)
                use = np.flatnonzero((todo & (EXPAND | RESOLVED)) == EXPAND)
                at = _spread(s.first[use], s.count[use])
                if len(at) and len(again):
                    x = s.rolling.at(at, at + length)
                    at = at[again[np.minimum(np.searchsorted(again, x), len(again) - 1)] == x]
                    np.add.at(change, s.begin + at, 1)
                    np.add.at(change, s.begin + at + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            rows, start = [], 0
            for doc_id, null, end in zip(doc_ids.tolist(), nulls.tolist(), ends.tolist(), strict=True):
                own, text = gone[start:end], data[start:end]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).tolist()
                kept = (text[~own] if edges else text).tobytes()
                spans = [{"begin": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                rows.append((None if null else doc_id, end - start, end - start - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, *[kept] * texts))
                start = end
            yield _batch(rows, out)

    actions = written(chunks.mapInArrow(sample, BLOBS).groupBy("bucket").applyInArrow(ranked, SIDE), "actions")
    acted = with_side(chunks, actions, "actions")
    narrow = acted.where("actions is not null").mapInArrow(windows, BLOBS)
    hits = written(narrow.groupBy("bucket").applyInArrow(repeated, SIDE), "hits")
    return with_side(acted, hits, "hits").mapInArrow(remove, schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents"), texts=False).drop("spans")


#: DuckDB SQL for op9: every window of 200 bytes (400 hex digits) by its digest.
ORACLE = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - 199, 0))) AS p FROM h)),
hits AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1),
steps AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM hits),
islands AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM steps),
spans AS (SELECT doc_id, min(p) AS first, max(p) + 200 AS beyond FROM islands GROUP BY doc_id, island),
parts AS (SELECT doc_id, first, beyond, lag(beyond, 1, 0) OVER (PARTITION BY doc_id ORDER BY first) AS start FROM spans),
kept AS (SELECT doc_id, sum(beyond - first) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * start + 1, 2 * (first - start)), '' ORDER BY first) || substr(any_value(h), 2 * max(beyond) + 1) AS k
  FROM parts JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM h LEFT JOIN kept ON h.doc_id = kept.doc_id"""
