"""Clashing columns, repeated and null ids, ties, texts longer than a chunk, a shard or a block, and the session's settings."""

import collections
import random
import zlib

import pytest

import corpus_pipeline
from blockfold.llm import chunks, decontamination, idfiles, linededup, packing, quality, scoring, sharding, simhash, suffixdedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def line(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(17)
    passage = line(r, 80)
    long = "\n".join(line(r, 12) for _ in range(4000))
    return [line(r, 60), line(r, 60) + "\n" + passage, line(r, 30) + "\n" + passage, long, long + "\n" + line(r, 5), "", None, "x"]


CLASHES = {
    "quality": (quality.judge, ("docs", "_ref", "_row", "_lang", "_text", "_common", "r_c_white", "c_white", "w_0", "_words", "_n")),
    "lines": (linededup.without_runs, ("did", "th", "spans", "_did", "_th", "_spans", "fp", "hub", "line", "_")),
    "shards": (sharding.shard, ("_base", "_part", "_place", "_arrival", "_x", "row", "_row", "n")),
    "ids": (simhash.near_duplicates, ("fp", "root", "node", "text_key", "least_id", "component_id")),
    "pieces": (lambda df: packing.pack(df, packing.tokenizer_path("word_bpe_49k.json")), ("piece", "ids", "_row", "length", "offset")),
    "scores": (scoring.score, ("chunk", "body", "bucket", "kind", "counts")),
    "substrings": (suffixdedup.removal, ("chunk", "actions", "hits", "data", "size")),
}


@pytest.mark.parametrize("name", CLASHES)
def test_columns_with_clashing_names(spark, texts, name):
    operator, names = CLASHES[name]
    plain = [(i, t, "en") for i, t in enumerate(texts)]
    rows = [(*r, *(f"own {n} {r[0]}" for n in names)) for r in plain]
    schema = "doc_id long, text string, lang string"
    wide = spark.createDataFrame(rows, schema + "".join(f", `{n}` string" for n in names))
    got, want = operator(wide), operator(spark.createDataFrame(plain, schema))
    of = lambda df: sorted(df.drop("sequence_id", "offset").select(*[c for c in want.columns if c in df.columns and c not in ("sequence_id", "offset")]).collect(), key=repr)
    assert of(got) == of(want)
    stay = [n for n in names if n in got.columns and n not in want.columns]
    assert all(r[n] == f"own {n} {r.doc_id}" for r in got.collect() for n in stay)


def test_decontamination_with_clashing_names(spark, texts):
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string, _row string")
    bench = spark.createDataFrame([(1, texts[0][:100], "z")], "item_id long, text string, n string")
    assert decontamination.search(df, bench).where("n_hit > 0").count() == 1


def test_near_dedup_counts_rows_not_ids(spark):
    r = random.Random(3)
    w, u = line(r, 60), line(r, 60)
    near = u.rsplit(" ", 1)[0]
    rows = [(1, w), (2, w), (2, u), (7, near), (7, near), (None, u), (None, None), (3, ""), (1, w), (None, line(r, 20)), (None, "solo text")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS).repartition(3)
    left = collections.Counter((x.doc_id, x.text) for x in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert left == collections.Counter({(1, w): 1, (2, u): 1, (3, ""): 1, rows[9]: 1, rows[10]: 1})


def test_stages_with_odd_rows(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, line(r, 60), "en", "s", 1) for i in range(4)] + [(2, line(r, 70), None, None, None), (None, line(r, 60), "xx", "s", 1), (None, None, None, None, None), (5, "", "en", "s", 0)]
    rows += rows[:1]
    df = spark.createDataFrame(rows, COLUMNS)
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for n, docs in ((6, df), (0, df.limit(0))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{n}/{k}")
            assert k == 4 or docs.columns == corpus_pipeline.COLUMNS
        assert docs.count() == n


def test_texts_beyond_chunk_shard_and_block(spark, texts, tmp_path, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    item = spark.createDataFrame([(1, " ".join(texts[3].split()[500:520]))], "item_id long, text string")
    path = packing.tokenizer_path("byte_bpe_50k.json")

    def results(name):
        idfiles.write_ids(df, f"file://{tmp_path}/{name}", path)
        lm = [(x.doc_id, x.n_tokens, x.n_known, x.score) for x in scoring.score(df).collect()]
        cut = [(x.doc_id, x.n_removed, x.kept_sha256) for x in suffixdedup.removal(df, texts=False).collect()]
        hit = [(x.doc_id, x.n_words, x.n_hit) for x in decontamination.search(df, item).collect()]
        ids = [(x.doc_id, x.start, x.n_tokens, x.ids_crc32) for x in idfiles.read_ids(spark, f"file://{tmp_path}/{name}").collect()]
        return [sorted(x, key=repr) for x in (lm, cut, hit, ids)]

    want = results("a")
    assert [n for _, _, n in want[2] if n] == [20, 20]
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(decontamination, "SHARD_BYTES", 1000)
    monkeypatch.setattr(idfiles, "BLOCK_BYTES", 1000)
    assert results("b") == want


def test_the_session_stays_as_it_is(spark, texts):
    before = dict(spark.conf.getAll)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scoring.score(df).count()
    suffixdedup.removal(df).count()
    simhash.near_duplicates(df).count()
    assert dict(spark.conf.getAll) == before


def test_language_references_at_every_size(spark):
    r = random.Random(2)
    vocab = {"en": line(r, 200).split(), "qq": "жук лес дом мир сад нос рот дым лук мак".split()}
    rows = [(i, " ".join(r.choice(vocab["en"]) for _ in range(150)), "en") for i in range(30)] + [(50, " ".join(r.choice(vocab["qq"]) for _ in range(20)) + " " + " ".join(f"слово{k}" for k in range(60)), "qq")]
    judged = {x.doc_id: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert judged[50].kept and judged[50].char_distance == judged[50].word_distance == 0
    common = {x["_ref"]: x["_common"] for x in quality.common_words(spark.createDataFrame([("a", "b B c c a"), ("a", None), ("b", "")], "_lang string, _text string")).collect()}
    assert common == {"a": ["b", "c", "a"]}


def test_crc_of_held_out_documents():
    assert [scoring.held_out(i) for i in (None, 0, 1, 2, 3)] == [False] + [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(4)]
