"""The pipeline's stages on a small table with planted cases, each against brute force over its own input."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from test_llm_operators import runs_by_force
from test_near_copies import groups, sets_of
from tokenizers import Tokenizer

import corpus_pipeline
from blockfold.llm import decontamination, packing, quality, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    item, passage = line(30), line(60)
    texts = {i: "\n".join(line(40) for _ in range(3)) for i in range(30)}
    texts[30] = line(150)
    near = texts[30].split(" ")
    near[20] = "changed"
    texts |= {40: texts[0], 41: texts[1] + "\n" + passage, 42: line(50) + "\n\n" + passage, 43: line(30) + " " + item + " " + line(30), 44: "short", 45: "again " * 80, 46: None, 47: line(15) * 700}
    texts |= {48: " ".join(near), 49: line(120).upper(), 50: "", 51: item}
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en" if i % 7 or i == 49 else None, "s", None if t is None else len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts, item, passage


def distance(a, b):
    m, n = sum(a), sum(b)
    if not m or not n:
        return 0.0
    total = 0.0
    for x, y in zip(a, b):
        p, q = x / m, y / n
        total += sum(z * math.log2(z / ((p + q) / 2)) for z in (p, q) if z)
    return math.sqrt(max(total / 2, 0.0))


def kept_by_force(rows):
    """doc_ids that the quality rules keep."""
    found, counts = {}, collections.defaultdict(collections.Counter)
    for doc_id, text, lang in rows:
        words = WORD.findall(text or "")
        grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
        found[doc_id] = (words, lang or "", len(words) < 10 or 100 * len(hit) > 20 * len(words), text or "")
        counts[lang or ""].update(w.lower() for w in words)
    common = {k: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:10]] for k, c in counts.items()}

    def histograms(words, lang, text):
        kinds = collections.Counter("upper" if "A" <= c <= "Z" else "lower" if "a" <= c <= "z" else "digit" if "0" <= c <= "9" else "symbol" if c in "#*$%&|<>" else "other" if c > "\x7f" else "punct" for w in words for c in w)
        kinds["white"] = len(text) - sum(map(len, words))
        lower = collections.Counter(w.lower() for w in words)
        own = [lower[w] for w in common[lang]]
        return [kinds[k] for k in ("white", "lower", "upper", "digit", "symbol", "other", "punct")], [*own, len(words) - sum(own)]

    sums = {}
    for words, lang, failed, text in found.values():
        if not failed:
            for k, h in enumerate(histograms(words, lang, text)):
                sums[lang, k] = [a + b for a, b in zip(sums.get((lang, k), [0] * len(h)), h)]
    out = set()
    for doc_id, (words, lang, failed, text) in found.items():
        if not failed:
            chars, own = (distance(h, sums[lang, k]) for k, h in enumerate(histograms(words, lang, text)))
            if (len(words) < quality.MIN_CHAR_WORDS or chars <= quality.MAX_CHAR_DISTANCE) and (len(words) < quality.MIN_WORD_WORDS or own <= quality.MAX_WORD_DISTANCE):
                out.add(doc_id)
    return out


def test_stages(spark, folder, tmp_path):
    path, texts, item, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    states = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, states[-1], path).write.parquet(f"{tmp_path}/{k}")
        states.append(spark.read.parquet(f"{tmp_path}/{k}"))
    _, kept, lines, near, clean, packed = states
    assert all(s.columns == corpus_pipeline.COLUMNS for s in states[:5])
    of = lambda df: {r.doc_id: r.text for r in df.collect()}

    before, after = of(kept), of(lines)
    assert set(before) == kept_by_force([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    assert set(range(30)) <= set(before) and not {44, 45, 46, 49, 50} & set(before)

    gone = runs_by_force(sorted(before.items()), 50)
    cut = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((d, t), ())) for d, t in before.items()}
    assert after == {d: t for d, t in cut.items() if t == before[d] or WORD.search(t)}
    assert 40 not in after and after[41] == passage and passage not in after[42]

    ids = sorted(after)
    sets, fps = [sets_of(after[d]) for d in ids], [simhash.fingerprint(after[d], 5) for d in ids]
    linked = lambda i, j: bool(sets[i]) and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) or (fps[i] ^ fps[j]).bit_count() <= 4
    stays = {ids[i] for i, g in enumerate(groups([after[d] for d in ids], linked)) if i == g}
    assert of(near) == {d: after[d] for d in stays} and 48 in after and 48 not in stays and 30 in stays

    window = {tuple(decontamination.words_of(item)[i : i + 10]) for i in range(21)}
    want = {}
    for d in stays:
        words = decontamination.words_of(after[d])
        hit = np.zeros(len(words), bool)
        for i in range(len(words) - 9):
            if tuple(words[i : i + 10]) in window:
                hit[i : i + 10] = True
        spans = [{"begin": a, "end": b} for a, b in decontamination.byte_spans(after[d], hit)]
        want[d] = decontamination.cut_spans(after[d], spans)
    assert of(clean) == want and item not in want[43]
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    plain = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    pieces = collections.Counter()
    for d, t in want.items():
        all_ids = np.asarray([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(all_ids), 4096)):
            pieces[d, k, at, zlib.crc32(all_ids[at : at + 4096].tobytes())] += 1
    rows = packed.collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in rows) == pieces
    used = collections.defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 4096 for x in used.values())
    assert len(used) == -(-sum(r.length for r in rows) // 4096)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).where("piece = 0").count() > 30


def test_cutting_passages_takes_one_python_worker(spark, folder, monkeypatch):
    """A task with one Python step after another holds a worker for each, and all of them stay with the executor."""
    path, texts, item, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    plan = corpus_pipeline.decontaminate(spark, docs, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    bench = spark.createDataFrame([(1, item), (2, texts[0][:100]), (3, None)], "item_id long, text string")
    got = {}
    for most in (decontamination.BLOCK_WORDS, 12):
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", most)
        rows = decontamination.search(docs, bench, extra=("text",), cut=True).collect()
        assert all(r.kept == decontamination.cut_spans(r.text, r.spans) for r in rows)
        got[most] = {r.doc_id: r.kept for r in rows}
    assert len({repr(sorted(x.items())) for x in got.values()}) == 1
    assert got[12] == texts | {d: got[12][d] for d in (0, 40, 43, 51)} and got[12][51] == "" and item not in got[12][43]
