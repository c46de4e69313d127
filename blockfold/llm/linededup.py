"""Line dedup by winnowing over line hashes.

A document is a sequence of line hashes (white space normalised, lines without
words left out). The shortest run of whole lines with at least `words` words
from every line on, and up to every line, is a window. The least line hash of
each window (the last of equal ones) is selected as a fingerprint: a sparse
set of positions. Which line of a window is selected depends on the window
alone, so two copies of a run with at least `words` words select the same
lines of it, one at least in each of its windows: that is the guarantee.

1. Fingerprints that stand at one position only end there.
2. Positions join the earliest position of their fingerprint, one each.
3. Every position knows its context: the lines around it up to and with the
   one that makes `words` words, so all windows that selected it lie inside.
   From the joined positions the match extends line by line both ways; if it
   has `words` words, its lines are a later repeated run.
4. Where the match ends before the context, something else may be repeated:
   of such positions, the windows that selected them and reach beyond the match
   are grouped by content, and all but the earliest are repeated. A position
   whose whole context matched needs no such look, since what it shares with
   any other is at the earliest position as well.

The runs found around neighbouring fingerprints overlap and make up the whole
repeated run. No two positions are paired but with the earliest, so a line in a
third of all documents costs a row for each of its positions, and partial
counts and minima go before each shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, fresh, id_key, small, table, text_key, written

WORDS = 50
POSITIONS = "did long, th long, line int, fp long, size int, before binary, after binary"
FOUND = "did long, th long, first int, last int, window long"
SPANS = "array<struct<first: int, last: int>>"
#: A line of a context: its hash and its words.
LINE = np.dtype([("hash", "<u8"), ("size", "<u4")])


def lines_of(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """Numbers, hashes and words of the lines that have words."""
    from xxhash import xxh64_intdigest

    numbers, hashes, sizes = [], [], []
    for number, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        own = line.split()
        if own:
            numbers.append(number)
            hashes.append(xxh64_intdigest(b" ".join(own)))
            sizes.append(len(own))
    return numbers, hashes, sizes


def windows(sizes: list[int], words: int) -> set[tuple[int, int]]:
    """(first, last) of each shortest run of lines with at least `words` words from a line on or up to one."""
    found = set()
    i = total = 0
    for j, size in enumerate(sizes):  # up to j
        total += size
        while total - sizes[i] >= words:
            total -= sizes[i]
            i += 1
        if total >= words:
            found.add((i, j))
    j, total = len(sizes) - 1, 0
    for i in range(len(sizes) - 1, -1, -1):  # from i
        total += sizes[i]
        while total - sizes[j] >= words:
            total -= sizes[j]
            j -= 1
        if total >= words:
            found.add((i, j))
    return found


def least(hashes: list[int], first: int, last: int) -> int:
    """Place of the least hash of a window, the last of equal ones."""
    run = hashes[first : last + 1]
    return last - run[::-1].index(min(run))


def reach(sizes: list[int], at: int, step: int, words: int) -> int:
    """How many lines beside `at` it takes to have `words` words, or all there are."""
    n, k, total = 0, at + step, 0
    while 0 <= k < len(sizes) and total < words:
        total += sizes[k]
        k += step
        n += 1
    return n


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _packed(hashes: list[int], sizes: list[int]) -> bytes:
    out = np.empty(len(hashes), LINE)
    out["hash"], out["size"] = hashes, sizes
    return out.tobytes()


def positions(text: str | None, words: int) -> list[tuple[int, int, int, bytes, bytes]]:
    """line, fingerprint, words of the line, and the context before (nearest first) and after, of each selected line; lines counted without empty ones."""
    _, hashes, sizes = lines_of(text)
    out = []
    for at in sorted({least(hashes, i, j) for i, j in windows(sizes, words)}):
        a, b = at - reach(sizes, at, -1, words), at + reach(sizes, at, 1, words)
        out.append((at, _signed(hashes[at]), sizes[at], _packed(hashes[a:at][::-1], sizes[a:at][::-1]), _packed(hashes[at + 1 : b + 1], sizes[at + 1 : b + 1])))
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """Leading lines two contexts have in common."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a["hash"][:n] != b["hash"][:n])
    return int(differ[0]) if len(differ) else n


def extended(fp: int, size: int, before: bytes, after: bytes, hub_before: bytes, hub_after: bytes, words: int) -> list[tuple[int, int, int | None]]:
    """(first, last, content) relative to a position: the match around it and its equal (content None), and windows that reach beyond it."""
    from xxhash import xxh64_intdigest

    left, right, hub_left, hub_right = (np.frombuffer(x, LINE) for x in (before, after, hub_before, hub_after))
    a, b = _alike(left, hub_left), _alike(right, hub_right)
    out: list[tuple[int, int, int | None]] = []
    if int(left["size"][:a].sum()) + size + int(right["size"][:b].sum()) >= words:
        out.append((-a, b, None))
    if (a, b) == (len(left), len(right)):
        return out
    at = len(left)
    hashes = [*left["hash"][::-1].tolist(), fp % 2**64, *right["hash"].tolist()]
    sizes = [*left["size"][::-1].tolist(), size, *right["size"].tolist()]
    for i, j in windows(sizes, words):
        if i <= at <= j and (i < at - a or j > at + b) and least(hashes, i, j) == at:
            content = b"".join(h.to_bytes(8, "big") for h in hashes[i : j + 1])
            out.append((i - at, j - at, _signed(xxh64_intdigest(content, at - i))))
    return out


def repeated_runs(df: DataFrame, words: int = WORDS) -> DataFrame:
    """did, th, spans: per document (keys of doc_id and text) the ranges of lines that occur earlier, in doc_id order.

    Lines are counted from 0 without those that have no words.
    """
    position_out, found_out = arrow(POSITIONS), arrow(FOUND)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [
                (did, th, *p)
                for did, th, text in zip(batch["did"].to_pylist(), batch["th"].to_pylist(), batch["text"].to_pylist(), strict=True)
                for p in positions(text, words)
            ]
            columns = zip(*rows, strict=True) if rows else [[]] * len(position_out)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, position_out, strict=True)], schema=position_out)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["did", "th", "line", "fp", "size", "before", "after", "hub_before", "hub_after"]
        for batch in small(batches):
            rows = []
            for did, th, line, *context in zip(*(batch[c].to_pylist() for c in fields), strict=True):
                rows += [(did, th, line + a, line + b, w) for a, b, w in extended(*context, words)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(found_out)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, found_out, strict=True)], schema=found_out)

    every = written(df.select(id_key().alias("did"), text_key().alias("th"), F.col("text").cast("string").alias("text")).mapInArrow(select, POSITIONS), "positions")
    place = F.struct("did", "th", "line")
    first = every.groupBy("fp").agg(F.min(place).alias("hub"), F.max(place).alias("last")).where("hub <> last")
    hubs = written(first.select("fp", "hub.*"), "hubs")
    joined = written(every.join(hubs.select("fp", F.struct("did", "th", "line").alias("hub")), "fp"), "joined")
    own = joined.where(place == F.col("hub")).dropDuplicates(["fp"]).select("fp", F.col("before").alias("hub_before"), F.col("after").alias("hub_after"))
    found = written(joined.where(place > F.col("hub")).drop("hub").join(own, "fp").mapInArrow(extend, FOUND), "found")
    runs = found.where("window is null").select("did", "th", "first", "last")
    beyond = found.where("window is not null")
    start = F.struct("did", "th", "first")
    earliest = beyond.groupBy("window").agg(F.min(start).alias("stays"), F.max(start).alias("latest")).where("stays <> latest").drop("latest")
    later = beyond.join(earliest, "window").where(start > F.col("stays")).select("did", "th", "first", "last")
    return runs.union(later).groupBy("did", "th").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))


def without_runs(df: DataFrame, words: int = WORDS) -> DataFrame:
    """df with `text` rid of later repeated runs, and n_lines, n_removed_lines, n_runs.

    Of a repeated run the place of least (doc_id, text key, line) stays, null
    doc_ids first. Lines without words go where they stand between lines that
    go. Texts without a repeated run, null and empty ones stay as they are (a
    null text has no lines). A text of any length is one row and takes memory in proportion to
    its lines. Rows with the same doc_id and text count as one document and
    fare alike. An empty table stays empty. Other columns stay, whatever their
    names; those with a result's name are replaced. Lines and windows are
    compared by 64-bit hashes.
    """
    df = df.drop("n_lines", "n_removed_lines", "n_runs")
    spans = repeated_runs(df, words)
    keep = [f for f in df.schema if f.name != "text"]
    made = fresh(df, "did", "th", "spans")
    schema = "text string, n_lines int, n_removed_lines int, n_runs int" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in keep)
    out = arrow(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for text, spans in zip(batch["text"].to_pylist(), batch[made["spans"]].to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                runs: list[list[int]] = []
                for s in sorted(spans or [], key=lambda s: (s["first"], s["last"])):
                    if runs and s["first"] <= runs[-1][1] + 1:
                        runs[-1][1] = max(runs[-1][1], s["last"])
                    else:
                        runs.append([s["first"], s["last"]])
                numbers = lines_of(text)[0] if runs else []
                gone = {k for a, b in runs for k in range(numbers[a], numbers[b] + 1)}
                kept = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text
                rows.append((kept, len(lines), len(gone), len(runs)))
            own = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, list(out)[:4], strict=True)]
            yield pa.record_batch([*own, *(batch[f.name] for f in keep)], schema=out)

    keyed = df.withColumn("text", F.col("text").cast("string")).withColumn(made["did"], id_key()).withColumn(made["th"], text_key())
    named = spans.select(F.col("did").alias(made["did"]), F.col("th").alias(made["th"]), F.col("spans").alias(made["spans"]))
    joined = keyed.join(named, [made["did"], made["th"]], "left").drop(made["did"], made["th"])
    return joined.mapInArrow(cut, schema).select(*df.columns, "n_lines", "n_removed_lines", "n_runs")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed_lines", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: DuckDB SQL for op6: every window as the text of its lines.
ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS number FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l),
w AS (SELECT doc_id, number, norm, len(string_split(norm, ' ')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY number) AS k FROM n WHERE norm <> ''),
c AS (SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS upto FROM w),
e AS (SELECT doc_id, k, upto, upto - words AS start, upto - words + WORDS AS enough, upto - WORDS AS most FROM c),
spans AS (
  SELECT a.doc_id, a.k AS i, b.k AS j FROM e a ASOF JOIN e b ON a.doc_id = b.doc_id AND a.enough <= b.upto
  UNION
  SELECT a.doc_id, b.k AS i, a.k AS j FROM e a ASOF JOIN e b ON a.doc_id = b.doc_id AND a.most >= b.start),
d AS (SELECT doc_id, list(norm ORDER BY k) AS lines FROM c GROUP BY doc_id),
runs AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY array_to_string(lines[i:j], chr(10)) ORDER BY doc_id, i) AS nth FROM spans JOIN d USING (doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS k FROM runs WHERE nth > 1),
removed AS (
  SELECT g.doc_id, w.number AS first, coalesce(x.number, w.number + 1) AS beyond, x.number IS NULL AS ends
  FROM gone g JOIN w ON g.doc_id = w.doc_id AND g.k = w.k
  LEFT JOIN (SELECT doc_id, k, number FROM gone JOIN w USING (doc_id, k)) x ON x.doc_id = g.doc_id AND x.k = g.k + 1),
numbers AS (SELECT doc_id, unnest(range(first, beyond)) AS number FROM removed),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(r.number) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.number) FILTER (r.number IS NULL), '') AS t
  FROM l LEFT JOIN numbers r ON l.doc_id = r.doc_id AND l.number = r.number GROUP BY l.doc_id),
counts AS (SELECT doc_id, count(*) FILTER (ends) AS n FROM removed GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed_lines, coalesce(counts.n, 0)::INTEGER AS n_runs, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN kept ON documents.doc_id = kept.doc_id LEFT JOIN counts ON documents.doc_id = counts.doc_id""".replace("WORDS", str(WORDS))
