"""Scores against a model of exact pair counts."""

import collections
import math
import random
import zlib

import pytest

from blockfold.llm import chunks, scoring


def test_scores_of_pairs(spark, monkeypatch):
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("abc") for _ in range(r.randint(0, 80))) for _ in range(60)]
    texts += ["zz " + t for t in texts[:3]]
    rows = list(enumerate(texts))
    of = lambda t: [None, *t.encode().split(), b"\n"]
    train = [of(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for ws in train for w in ws[1:])
    pairs = collections.Counter(p for ws in train for p in zip(ws, ws[1:]))
    c[None] = len(train)  # the start symbol
    n, v = sum(c.values()) - c[None], len(c) - 1
    levels = collections.defaultdict(list)
    for k in pairs.values():
        levels[k.bit_length()].append(k)
    mean = {q: sum(ks) / len(ks) for q, ks in levels.items()}
    once = 0

    def score(ws):
        nonlocal once
        total = 0.0
        for a, w in zip(ws, ws[1:]):
            k = pairs[a, w]
            once += k == 1
            base = (c[w] + 1) / (n + v + 1)
            seen = min(1.0, mean[k.bit_length()] / c[a]) if k else 0.0
            total += math.log10(0.2 * seen + 0.8 * base if c[a] else base)
        return total

    want = {i: score(of(t)) for i, t in rows}
    assert once > 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = None
    for most, parts in ((scoring.MAX_FILTER, 4), (20, 4), (scoring.MAX_FILTER, 16), (20, 3)):
        monkeypatch.setattr(chunks, "CHUNK_BYTES", 500 * parts)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {x.doc_id: x.score for x in scoring.score(df.repartition(parts), max_filter=most).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        first = first or got
        assert got == first  # whatever the partitions, chunks and the way to the filter
        assert got == pytest.approx(want, rel=0.05)
        # the filter's false positives only raise scores
        assert all(got[i] >= want[i] - 1e-6 for i in want)
        assert sum(got[i] == pytest.approx(want[i]) for i in want) > len(want) / 4
