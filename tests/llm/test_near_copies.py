"""Near copies by overlap of shingles, against brute force over all pairs."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from blockfold.llm import jaccard, simhash


def sets_of(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def make_texts():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    common = " ".join(word() for _ in range(25))
    texts = []
    for k in range(60):
        own = [word() for _ in range(r.choice([14, 40, 150, 400]))]
        texts.append(" ".join(own) + (" " + common if k % 2 else ""))
        for _ in range(r.randint(0, 3)):  # chains of copies, some words changed, at places of their own or at the end
            w = texts[-1].split()
            for at in r.sample(range(len(w)), r.randint(0, 1 + len(w) // 50)):
                w[at] = word()
            texts.append(" ".join(w[: r.randint(len(w) * 4 // 5, len(w))]))
    base = [word() for _ in range(24)]  # 20 shingles; without the last four words 16: exactly 0.8
    return [*texts, " ".join(base), " ".join(base[:-4]), "", "a b", "A  b", common, common.upper() + " x"]


def groups(texts, linked):
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if linked(i, j):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("sample,few,block", [(20_000, 16, 4096), (30, 2, 4096), (20_000, 1, 3)])
def test_near_copies_are_dropped(spark, monkeypatch, sample, few, block):
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = make_texts()
    sets = [sets_of(t) for t in texts]
    fps = [simhash.fingerprint(t, 5) for t in texts]
    overlap = lambda i, j: bool(sets[i]) and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
    bits = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4
    want = groups(texts, lambda i, j: overlap(i, j) or bits(i, j))
    assert sum(overlap(i, j) and not bits(i, j) for i, j in itertools.combinations(range(len(texts)), 2)) > 10
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(900, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept - {900} == {i for i, g in enumerate(want) if i == g}
    assert corpus_pipeline.near_dedup(spark, docs.where("doc_id < 0"), "").count() == 0


def test_prefixes_meet():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 20, 300):
        pool = r.integers(0, 2**63, 2 * n).astype(np.uint64)
        common = np.unique(pool[::3])
        for _ in range(20):
            a = np.unique(pool[:n])
            keep = r.permutation(a)[: max(1, int(np.ceil(0.8 * len(a))))]
            b = np.unique(keep)
            counts = np.arange(len(common)) % 7 + 3
            assert set(jaccard.prefix(a, common, counts, 0.8).tolist()) & set(jaccard.prefix(b, common, counts, 0.8).tolist())


def test_bitmaps_allow_all_similar_pairs():
    r = np.random.default_rng(4)
    sets = []
    for n in (1, 3, 40, 130, 200, 700, 5000):
        base = r.integers(0, 2**63, n).astype(np.uint64)
        for share in (1.0, 0.95, 0.9, 0.85, 0.8, 0.5, 0.0):
            more = r.integers(0, 2**63, n - int(share * n)).astype(np.uint64)
            sets.append(np.unique(np.concatenate([base[: int(share * n)], more])))
        sets.append(np.unique(base[: max(1, int(0.8 * n))]))
    sizes = np.array([len(x) for x in sets])
    similar = {(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j]))}
    for side in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
        i, j = jaccard.close_pairs(sizes, side, np.arange(len(sets)), [jaccard.parity(x) for x in sets], 0.8)
        got = {(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist())}
        want = {(a, b) for a, b in similar if side[a] != side[b] or not side.any()}
        assert want <= got and len(got) == len(i) and len(got) < 3 * len(want) + 20
