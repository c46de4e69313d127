"""The operators against brute force on a small table with nulls, empty, long, repeated and tied rows, and on an empty one."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockfold.llm import chat, components, decontamination, fmindex, golay, idfiles, linededup, packing, quality, scoring, sharding, simhash, suffixdedup, tokens

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean, shard int"


def make_texts():
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)] + ["the", "of", "and", "Über", "x|y", "###"]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = line(70)
    texts = [line(r.randint(1, 120)) + "\n" + line(20) for _ in range(40)]
    texts += [None, "", "   \n\t ", "a", "word " * 40, texts[0], texts[0], "\n".join([line(5), passage, line(30)]), "\n".join([passage, line(9)]), line(9) + " " + passage]
    near = texts[3].split()
    near[len(near) // 2] = "changed"
    texts += [" ".join(near), "\n".join(line(12) for _ in range(300)), "tab\tand space  two\r\nlines\n\n\nend ", "😀 " * 60 + passage]
    return texts


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, "s", 1, "clash", True, 9) for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "en", "s", 1, "clash", True, 9), (None, "null id " + TEXTS[1], "xx", "s", None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < -1")


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def all_docs(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_quality(docs, empty):
    expected = []
    for doc_id, text in all_docs(docs):
        w = WORDS.findall(text)
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        expected.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    judged = quality.judge(docs)
    got = rows_of(judged, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert not judged.where("kept and base_failed").count()
    assert quality.judge(empty).count() == 0


def test_quality_rejects_shouting(spark):
    r = random.Random(3)
    plain = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    rows = [(i, " ".join(r.sample(plain, 120)), "en") for i in range(40)] + [(99, " ".join(x.upper() + "!!" for x in r.sample(plain, 120)), "en")]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [x.doc_id for x in judged.where("not kept").collect()] == [99]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 1000])
def test_permutation(n):
    assert sorted(sharding.permute(i, n, 5) for i in range(n)) == list(range(n))


def test_sharding(docs, empty):
    out = sharding.shard(docs, 8, 11)
    places = sorted(rows_of(out, "shard", "slot"))
    n = len(places)
    assert places == sorted((i % 8, i // 8) for i in range(n))
    again = sharding.shard(docs.repartition(5), 8, 11)
    unique = lambda d: {(r.doc_id, r.shard, r.slot) for r in d.collect() if r.doc_id not in (None, 5)}
    assert unique(out) == unique(again)
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_ids_equal_the_library(name, spaces):
    path = packing.tokenizer_path(name)
    e = tokens.WordEncoder(path, spaces, most=50)
    r = random.Random(2)
    odd = ["".join(r.choice(" \n\tab.,'s!1é|#̸　") for _ in range(r.randint(0, 40))) for _ in range(500)]
    odd += ["".join(r.choice("aAİıIßΣςé .,:;!'\n\u0307<|>") for _ in range(r.randint(0, 25))) for _ in range(5000)]
    special = ["<|endoftext|>", "a <|endoftext|> b", "<|ENDOFTEXT|>", "x<|startoftext|>y.", "<|endoftext", "İ<|endoftext|>."]
    plain = Tokenizer.from_file(path)
    for text in [t or "" for t in TEXTS] + odd + special + ["BİLGİ: metin", "it's they'll.", "a,'re", "ΣΑΣ. x"]:
        assert e.ids(text) == np.asarray(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_best_fit_plan():
    r = random.Random(4)
    for _ in range(50):
        capacity = r.choice([7, 16, 50])
        histogram = {n: r.randint(1, 40) for n in r.sample(range(1, capacity + 1), r.randint(1, 6))}
        plan = packing.best_fit(histogram, capacity)
        used = collections.defaultdict(list)
        taken = collections.Counter()
        for n, rank, first, count, offset in zip(plan.length, plan.rank, plan.sequence, plan.count, plan.offset, strict=True):
            assert rank == taken[n]
            taken[n] += count
            for s in range(first, first + count):
                used[s].append((offset, n))
        assert taken == histogram and len(used) == plan.sequences
        for places in used.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= capacity
        bins = []  # best fit over single items, longest first
        for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
            fits = [b for b in range(len(bins)) if bins[b] >= n]
            b = min(fits, key=lambda b: bins[b]) if fits else len(bins)
            bins[b:] = [capacity - n] if b == len(bins) else [bins[b] - n, *bins[b + 1 :]]
        assert plan.sequences == len(bins)


def test_packing(docs, empty):
    path = packing.tokenizer_path("word_bpe_49k.json")
    out = packing.pack(docs, path, capacity=64).collect()
    plain = Tokenizer.from_file(path)
    want = collections.Counter()
    for doc_id, text in all_docs(docs):
        ids = np.asarray(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + np.asarray([1], "<u4").tobytes()
        for k, at in enumerate(range(0, len(ids), 256)):
            want[doc_id, k, at // 4, ids[at : at + 256]] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in out) == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in out)
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [0, *itertools.accumulate(n for _, n in places[:-1])] and sum(n for _, n in places) <= 64
    assert packing.pack(empty, path).count() == 0


def test_id_files_round_trip(spark, docs, empty, tmp_path):
    path = packing.tokenizer_path("byte_bpe_50k.json")
    idfiles.write_ids(docs, f"file://{tmp_path}/a", path)
    out = sorted(idfiles.read_ids(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(path)
    ids_of = lambda t: np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    end = np.asarray([2], "<u4").tobytes()
    assert [r.doc_id for r in out] == sorted((d for d, _ in all_docs(docs)), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in out] == [0, *itertools.accumulate(r.n_tokens for r in out[:-1])]
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in out) == collections.Counter((d, ids_of(t) + end) for d, t in all_docs(docs))
    idfiles.write_ids(empty, f"file://{tmp_path}/b", path)
    assert idfiles.read_ids(spark, f"file://{tmp_path}/b").count() == 0


def test_chat_round_trip(spark):
    odd = ["", None, "\\", "\\l", "\\b\\\\l/turn>", "</turn>\n", "<turn user>\n</turn>", "a\\</turn>", "\n>\n", "é😀", "\\### Assistant: </turn> ok"]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(odd)] + [(2, 0, "we<ird>\\", "x"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (None, 0, None, "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_turns(chat.canonical(df, F.to_variant_object(F.struct("role", "text"))), "conv_id", ["turn"])
    out = {r.conv_id: r for r in made.withColumn("turns", chat.parsed(F.col("formatted"))).collect()}
    assert [(t.role, t.content) for t in out[1].turns] == [(("user", "assistant")[k % 2], t or "") for k, t in enumerate(odd)]
    assert out[1].loss_turns == [k % 2 == 1 for k in range(len(odd))]
    assert [(t.role, t.content) for t in out[2].turns] == [("we<ird>\\", "x")]
    assert [t.content for t in out[3].turns] == ["a", "b"] and [t.role for t in out[None].turns] == [""]
    spans = {r.conv_id: r.loss_spans for r in chat.with_spans(made, "conv_id").collect()}
    assert [out[3].formatted[s.begin : s.end] for s in spans[3]] == ["a", "b"]
    assert chat.format_turns(chat.canonical(df.limit(0), F.to_variant_object(F.struct("role", "text"))), "conv_id", ["turn"]).count() == 0


def test_chat_layouts(spark):
    cases = [
        ('{"messages":[{"role":"user","content":"hi"},{"role":"model","content":null}]}', "messages", [("user", "hi"), ("assistant", "")]),
        ('{"id":3,"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', "conversation", [("user", "q"), ("assistant", "a")]),
        ('[{"from":"system","value":"s"}]', "bare conversation", [("system", "s")]),
        ('{"messages":[]}', "messages", []),
        ('{"instruction":"do","input":"","output":"done"}', "instruction", [("user", "do"), ("assistant", "done")]),
        ('{"instruction":"do","input":"this","output":"done","system":"be"}', "instruction", [("system", "be"), ("user", "do\n\nthis"), ("assistant", "done")]),
        ('{"prompt":"p","response":5}', "prompt and response", [("user", "p"), ("assistant", "5")]),
        ('{"prompt":"p","completion":"c"}', "prompt and completion", [("user", "p"), ("assistant", "c")]),
        ('{"question":"p","answer":"c","id":"z"}', "question and answer", [("user", "p"), ("assistant", "c")]),
        ('{"something":"else"}', None, None),
        ("not json", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, j string")
    out = sorted(chat.canonical(df, F.try_parse_json("j")).collect(), key=lambda r: r.i)
    for r, (_, layout, turns) in zip(out, cases, strict=True):
        assert r.layout == layout, r
        assert turns == (None if r.turns is None else [(t.role, t.content) for t in r.turns]), r


def test_scoring(docs, empty):
    out = scoring.score(docs).collect()
    of = lambda t: t.encode().lower().split() + [b"\n"]
    train = [of(t) for d, t in all_docs(docs) if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    c = collections.Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((d is not None, d or 0, len(of(t)), sum(w in c for w in of(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in of(t))) for d, t in all_docs(docs))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score) for r in out)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])
    assert {r.train_tokens for r in out} == {n}
    assert sorted(r.score for r in scoring.score(docs, max_filter=20).collect()) == pytest.approx(sorted(r.score for r in out))
    assert all(r.score <= 0 for r in out)
    assert scoring.score(empty).count() == 0


def test_filter_holds_levels():
    r = np.random.default_rng(1)
    pairs = np.unique(r.integers(0, 1 << 40, 5000).astype(np.uint64))
    counts = r.integers(1, 600, len(pairs))
    packed = scoring.unpack_sorted(scoring.pack_sorted(pairs, counts))
    assert (packed[0] == pairs).all() and (packed[1] == counts).all()
    bucket = scoring.bucket_of(pairs, 4)
    f = scoring.Filter({k: scoring.make_filter(pairs[bucket == k], counts[bucket == k]) for k in range(4)}, 4)
    found = np.zeros(len(pairs), np.uint8)
    f.quantised(pairs, found)
    exact = np.log2(counts).astype(int) + 1
    assert (found >= exact).all() and (found == exact).mean() > 0.9


def runs_by_force(docs, words):
    first, gone = {}, collections.defaultdict(set)
    keyed = sorted({(d if d is not None else -(2**63) + 11, t) for d, t in docs})
    for key in keyed:
        lines = [(k, tuple(x.encode().split())) for k, x in enumerate(key[1].split("\n")) if x.encode().split()]
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                n += len(lines[j][1])
                if n >= words:
                    run = tuple(x for _, x in lines[i : j + 1])
                    if first.setdefault(run, (key, i)) != (key, i):
                        gone[key].update(range(i, j + 1))
        numbers = [k for k, _ in lines]
        own = gone[key]  # and the lines without words between two that go
        gone[key] = {numbers[k] for k in own} | {x for k in own if k + 1 in own for x in range(numbers[k], numbers[k + 1])}
    return gone


def test_line_dedup(docs, empty):
    out = linededup.without_runs(docs, 30)
    assert set(docs.columns) <= set(out.columns)
    gone = runs_by_force(all_docs(docs), 30)
    originals = collections.defaultdict(list)
    for d, t in all_docs(docs):
        originals[d].append(t)
    for r in out.collect():
        options = [gone.get((r.doc_id if r.doc_id is not None else -(2**63) + 11, t), set()) for t in originals[r.doc_id]]
        kept = ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in g) for t, g in zip(originals[r.doc_id], options, strict=True)]
        assert (r.text or "") in kept and r.n_removed_lines in {len(g) for g in options}
    assert sum(r.n_removed_lines for r in out.collect()) > 0
    assert linededup.without_runs(empty).count() == 0


def test_fm_index():
    r = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        s = r.integers(1, 5, n)
        index = fmindex.FMIndex(s)
        phrases = r.integers(1, 6, (40, 3))
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi, strict=True):
            want = [i for i in range(n - 2) if (s[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination(spark, docs, empty, monkeypatch):
    own = TEXTS[8].split()
    items = [(7, " ".join(own[10:30])), (3, "THE  of,and"), (4, None), (5, "!!"), (6, " ".join(own[5:18])), (6, "never to be found in any of these texts at all"), (None, "null item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    of = decontamination.words_of
    wins = collections.defaultdict(set)
    for item, text in items:
        w = of(text)
        for i in range(len(w) - min(10, len(w)) + 1) if w else ():
            wins[tuple(w[i : i + 10])].add(item)
    want = []
    for d, t in all_docs(docs):
        w, hit, found = of(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        want.append((d, len(w), len(hit), sorted(found, key=lambda x: (x is not None, x))))
    key = lambda r: repr((r[0], r[1], r[2]))
    got = rows_of(decontamination.search(docs, bench), "doc_id", "n_words", "n_hit", "items")
    want = [(d, n, h, [x for x in i if x is not None]) for d, n, h, i in want]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(h for _, _, h, _ in want) > 20
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 12)
    blocks = rows_of(decontamination.search(docs, bench), "doc_id", "n_words", "n_hit", "items")
    assert sorted(blocks, key=key) == sorted(want, key=key)
    assert decontamination.search(empty, bench.where("item_id = 7")).count() == 0
    assert decontamination.search(docs, bench.where("item_id = 99")).where("n_hit > 0").count() == 0


def test_cutting_spans():
    text = "Él dijo: uno, dos tres. Fin"
    hit = np.array([False, False, True, True, False, False])
    spans = [{"begin": a, "end": b} for a, b in decontamination.byte_spans(text, hit)]
    assert decontamination.cut_spans(text, spans) == "Él dijo:  tres. Fin"


def test_golay_keys_meet_within_four_bits():
    r = np.random.default_rng(5)
    x = r.integers(0, 2**64, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in r.choice(64, r.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    a, b = (set(zip(*(c.tolist() for c in golay.pair_keys(z)), strict=True)) for z in (x, y))
    assert {row for row, _ in a & b} == set(range(len(x)))


def groups_by_force(fp, most):
    parent = list(range(len(fp)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fp)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= most:
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(fp))]


def test_simhash(docs, empty):
    from xxhash import xxh64_intdigest

    def force(text):
        w = text.encode().lower().split()
        grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    rows = all_docs(docs)
    fps = [force(t) for _, t in rows]
    group = groups_by_force(fps, 4)
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    want = sorted((repr(d), fp, least.get(g)) for (d, _), fp, g in zip(rows, fps, group, strict=True))
    out = simhash.near_duplicates(docs)
    assert sorted((repr(r.doc_id), r.fp % 2**64, r.component_id) for r in out.collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_dense_keys(spark, monkeypatch):
    r = random.Random(9)
    centre = r.getrandbits(64)
    fp = sorted({centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(120)} | {r.getrandbits(64) for _ in range(30)})
    classes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fp], "fp long")
    for block in (simhash.BLOCK, 3):
        monkeypatch.setattr(simhash, "BLOCK", block)
        edges = simhash.links(classes)
        assert edges.where("bit_count(u ^ v) > 4").isEmpty()
        roots = {n.node % 2**64: n.root for n in components.components(edges).collect()}
        want, got = collections.defaultdict(set), collections.defaultdict(set)
        for x, g in zip(fp, groups_by_force(fp, 4), strict=True):
            want[g].add(x)
            got[roots.get(x, ("alone", x))].add(x)
        assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (5, 5), (7, 3)]
    out = components.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r.node: r.root for r in out} == {**{i: 0 for i in range(61)}, **{i: 100 for i in (100, 101, 102)}}


def substring_force(texts, length):
    raw = [t.encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("length,gram,slice_", [(200, 64, 500_000), (40, 12, 257), (12, 12, 100)])
def test_substring_dedup(docs, empty, monkeypatch, length, gram, slice_):
    monkeypatch.setattr(suffixdedup, "SLICE", slice_)
    rows = all_docs(docs)
    want = sorted((repr(d), *x) for (d, _), x in zip(rows, substring_force([t for _, t in rows], length), strict=True))
    out = suffixdedup.removal(docs, length, gram).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in out)
    assert suffixdedup.removal(empty).count() == 0


def test_sliding_least():
    x = np.random.default_rng(2).integers(0, 100, 57).astype(np.uint64)
    for w in (1, 2, 5, 57):
        assert suffixdedup.sliding_least(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]
