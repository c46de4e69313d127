"""Benchmark decontamination: an FM-index per training shard answers the benchmark's phrases.

A shard is some millions of bytes of documents. Words that no benchmark item
has cannot lie in a match: each stretch of them becomes one separator symbol,
and stretches of benchmark words shorter than the shortest phrase go too. The
index over what remains finds the same occurrences as one over all words. They
are located, turned into word positions and merged into spans per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, fresh, small, table, written
from .fmindex import FMIndex

WINDOW = 10
#: Bytes of text per shard; words of benchmark items per broadcast.
SHARD_BYTES, BLOCK_WORDS = 16_000_000, 4_000_000
#: Lower case, and spaces for all that is not a word: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return 1


class Phrases(NamedTuple):
    """Distinct windows of a block of items by length, and each window's items."""

    vocabulary: _Vocabulary  # ids from 2; 1: not a benchmark word
    windows: dict[int, np.ndarray]  # length: (n, length) ids
    items: dict[int, list[np.ndarray]]  # length: item numbers of each window
    item_ids: list[int | None]


def phrases(items: list[tuple[int, str | None]], window: int) -> Phrases:
    vocabulary = _Vocabulary()
    found: dict[int, dict[tuple[int, ...], list[int]]] = {}
    for k, (_, text) in enumerate(items):
        ids = [vocabulary.setdefault(w, len(vocabulary) + 2) for w in words_of(text)]
        n = min(window, len(ids))
        for at in range(len(ids) - n + 1) if n else ():
            at_items = found.setdefault(n, {}).setdefault(tuple(ids[at : at + n]), [])
            if not at_items or at_items[-1] != k:
                at_items.append(k)
    return Phrases(
        vocabulary,
        {n: np.array(list(w), np.int64) for n, w in found.items()},
        {n: [np.array(x) for x in w.values()] for n, w in found.items()},
        [i for i, _ in items],
    )


def occurrences(docs: list[np.ndarray], p: Phrases) -> tuple[np.ndarray, list[set[int]]]:
    """Which words of a shard are hit (documents one after the other), and the item numbers in each document."""
    lengths = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(lengths)
    words = np.concatenate([np.zeros(0, np.int64), *docs])
    items: list[set[int]] = [set() for _ in docs]
    hit = np.zeros(len(words), bool)
    if not p.windows or not len(words):
        return hit, items
    # stretches of benchmark words within a document
    known = words >= 2
    edge = np.zeros(len(words) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = known[1:] != known[:-1]
    edge[ends] = True
    cuts = np.flatnonzero(edge)
    starts, stops = cuts[:-1], cuts[1:]
    use = known[starts] & (stops - starts >= min(p.windows))
    starts, stops = starts[use], stops[use]
    if not len(starts):
        return hit, items
    sizes = stops - starts + 1  # and a separator
    offsets = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) + np.repeat(starts - offsets, sizes)
    text = np.where(np.arange(len(place)) == np.repeat(offsets + sizes - 1, sizes), 1, words[np.minimum(place, len(words) - 1)])
    index = FMIndex(text)
    change = np.zeros(len(words) + 1, np.int64)
    for n, windows in p.windows.items():
        lo, hi = index.search(windows)
        count = hi - lo
        which = np.repeat(np.arange(len(windows)), count)
        rows = np.arange(int(count.sum())) + np.repeat(lo - (np.cumsum(count) - count), count)
        at = place[index.locate(rows)]
        np.add.at(change, at, 1)
        np.add.at(change, at + n, -1)
        pairs = np.unique(np.stack([np.searchsorted(ends, at, "right"), which], 1), axis=0)
        for doc, w in pairs.tolist():
            items[doc].update(p.items[n][w].tolist())
    return np.cumsum(change[:-1]) > 0, items


def byte_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of maximal runs of hit words, from the first word's begin to the last one's end."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(WORDS), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], raw.view(np.int8), [0]])))
    begins, ends = edge[::2], edge[1::2]
    runs = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [(int(begins[a]), int(ends[b - 1])) for a, b in zip(runs[::2], runs[1::2], strict=True)]


SCHEMA = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<begin: long, end: long>>"
KEPT = ", kept string"


def _search(df: DataFrame, p: Phrases, extra: list[str], cut: bool = False) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(p)
    columns = [df.schema[c] for c in extra]
    schema = SCHEMA + "".join(f", {f.name} {f.dataType.simpleString()}" for f in columns) + KEPT * cut
    out = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        get = p.vocabulary.__getitem__
        held: list[pa.RecordBatch] = []
        docs: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            hit, items = occurrences(docs, p)
            at = doc = 0
            for batch in held:
                rows, kept = [], []
                for text in batch["text"].to_pylist():
                    own = hit[at : at + len(docs[doc])]
                    at += len(own)
                    spans = byte_spans(text, own) if own.any() else []
                    rows.append((len(own), int(own.sum()), sorted({p.item_ids[k] for k in items[doc]} - {None}), [{"begin": a, "end": b} for a, b in spans]))
                    if cut:
                        kept.append(cut_spans(text, rows[-1][3]))
                    doc += 1
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                made = [pa.array(c, out.field(k + 1).type) for k, c in enumerate(columns)]
                yield pa.record_batch([batch["doc_id"], *made, *(batch[c] for c in extra), *[pa.array(kept, pa.string())] * cut], schema=out)

        for batch in small(batches):
            for text in batch["text"].to_pylist():
                words = words_of(text)
                docs.append(np.fromiter(map(get, words), np.int64, len(words)))
            held.append(batch)
            size += batch["text"].nbytes
            if size >= SHARD_BYTES:
                yield from flush()
                held, docs, size = [], [], 0
        yield from flush()

    extra = [c for c in extra if c != "doc_id"]
    keep = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c) for c in extra if c != "text")]
    return df.select(*keep).mapInArrow(run, schema)


def search(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, extra: tuple[str, ...] = (), cut: bool = False) -> DataFrame:
    """Per row of df (doc_id, text): n_words, n_hit, items (ids of items with an occurring window), byte spans to remove.

    Null, empty and wordless texts have no words and no hits; items without
    words have no windows, one without an id hits but is not listed. Repeated rows give a row each; of further columns
    those in `extra` are carried along. With `cut` there is a column `kept`
    besides, the text without its spans, made where the spans are found: a task
    that cut them afterwards would hold a second Python worker. An empty benchmark hits nothing. The
    benchmark is searched for in blocks of some BLOCK_WORDS words (a longer item
    is a block of its own), which go to the driver and the workers one at a
    time; beyond one, the blocks' results of a document are joined by a row
    number. A text of any length is one row in one shard.
    """
    words = F.regexp_count(F.lower("text"), F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).select("*", F.coalesce(words, F.lit(0)).alias("n"))
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total <= BLOCK_WORDS:
        return _search(df, block_of(items, window), list(extra), cut)
    # dealt by hash, half full on average
    n = -(-2 * total // BLOCK_WORDS)
    number = F.when(F.col("n") > BLOCK_WORDS // 2, F.concat(F.lit("item "), F.xxhash64("item_id", "text").cast("string"))).otherwise(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("string"))
    dealt = written(items.withColumn("block", number), "items")
    names = [r[0] for r in dealt.select("block").distinct().orderBy("block").collect()]  # a row per block
    return _many(df, [dealt.where(F.col("block") == x) for x in names], window, extra, cut)


def block_of(items: DataFrame, window: int) -> Phrases:
    """The phrases of one block of items, of bounded size."""
    return phrases([(r.item_id, r.text) for r in items.select("item_id", "text").collect()], window)


def _many(df: DataFrame, blocks: list[DataFrame], window: int, extra: tuple[str, ...], cut: bool) -> DataFrame:
    own = fresh(df, "row")["row"]
    rows = written(df.withColumn(own, F.monotonically_increasing_id()), "rows")
    parts = [written(_search(rows, block_of(b, window), [own]).where(("n_hit > 0") if k else "true"), "hits") for k, b in enumerate(blocks)]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    merged = every.groupBy(own).agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("spans")).alias("spans"),
    )

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            hits, spans = [], []
            for text, found in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                flag = np.zeros(0, bool)
                if found:
                    raw = (text or "").encode("utf-8", "surrogatepass").translate(WORDS)
                    begins = np.flatnonzero(np.diff(np.concatenate([[0], (np.frombuffer(raw, np.uint8) != 32).view(np.int8)])) == 1)
                    flag = np.zeros(len(begins), bool)
                    for s in found:
                        flag[np.searchsorted(begins, s["begin"]) : np.searchsorted(begins, s["end"])] = True
                hits.append(int(flag.sum()))
                spans.append([{"begin": a, "end": b} for a, b in byte_spans(text, flag)] if found else [])
            made = [batch["doc_id"], batch["n_words"], pa.array(hits, pa.int64()), batch["items"], pa.array(spans, out.field("spans").type)]
            kept = [pa.array([cut_spans(t, s) for t, s in zip(batch["text"].to_pylist(), spans, strict=True)], pa.string())] if cut else []
            yield pa.record_batch([*made, *(batch[c] for c in extra), *kept], schema=out)

    schema = SCHEMA + "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in extra) + KEPT * cut
    out = arrow(schema)
    return merged.join(rows.drop("doc_id", "n_words", "items", "spans"), own).mapInArrow(union, schema)


def cut_spans(text: str | None, spans: list[dict]) -> str | None:
    """A text without its spans."""
    if not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    edges = [0, *(e for s in spans for e in (s["begin"], s["end"])), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "surrogatepass")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: DuckDB SQL for op7: windows and documents' words as rows.
ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (
  SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT item_id, w, least(10, len(w)) AS m FROM bw WHERE len(w) > 0))),
lens AS (SELECT DISTINCT m FROM win),
pos AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s FROM (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m)),
hits AS (SELECT pos.doc_id, pos.i, pos.m, win.item_id FROM pos JOIN win ON pos.m = win.m AND pos.s = win.s),
words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS i FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.l, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM dw d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""
